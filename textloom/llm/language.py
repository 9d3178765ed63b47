"""Language ID by a linear-chain conditional random field over words.

Every word (a run of letters, lower-cased) gets emission scores from hashed features:
affixes of one to three letters, inner two- and three-letter grams, and the lexicons
of frequent words learnt for each language. Learnt transitions join the words of a
text, and forward-backward gives each word's posterior over the languages, so a text
that switches languages is labelled word by word. A document's language is the one
with most posterior mass; its score is that language's share.

Training: a bounded sample (``docs_per_lang`` documents a language, ``spans_per_doc``
spans of ``span_words`` words from anywhere in them, documented parameters) of rows
with a label; spans of different languages are joined into switched sequences, from
which the transitions are learnt by the exact gradient. The model is a table of
``BUCKETS`` rows with a column for each language, whatever the corpus. Prediction reads
whole texts and nothing but texts; ``label_words`` returns the language of every word.

A null text, or one without a letter, is ``und`` with score 0. Without any labelled
row, so for an empty table, everything is ``und``. Equal texts, repeated rows among them,
get equal results; ties go to the first label in alphabetic order. A very long text is
read in windows and needs memory in proportion to itself. A row without an id is judged
but not learnt from. Further columns, whatever their names, are not read; keep_known()
returns them unchanged.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, released, text_slices

BUCKETS = 1 << 17
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Settings:
    docs_per_lang: int = 500
    spans_per_doc: int = 8
    span_words: int = 12
    lexicon: int = 300
    sequences: int = 7000
    epochs: int = 3
    batch: int = 200
    rate: float = 0.5
    decay: float = 1e-6
    seed: int = 11


@dataclass
class Model:
    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    #: Log scores of a label after a label, and of the first label.
    moves: np.ndarray
    start: np.ndarray
    key: int = field(default=0)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def letters_only(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hashed feature) pairs of non-empty words: a bias, prefixes and
    suffixes of one to three letters, grams of two and three, and the lexicon entry."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    every = np.arange(len(words))
    owner = np.repeat(every, sizes)
    left = np.repeat(first + sizes, sizes) - np.arange(len(codes))  # letters from here to the word's end
    at = [every, every]
    # the languages whose lexicons hold the word, as a number whatever their number
    bits = np.fromiter((hash(lexicon.get(w, 0)) & 0x7FFFFFFFFFFFFFFF for w in words), dtype=np.uint64, count=len(words))
    found = [np.zeros(len(words), dtype=np.uint64), _mix(bits, 9)]
    gram = codes
    for k in (1, 2, 3):
        if k > 1:
            gram = gram[:-1] * _STEP + codes[k - 1 :] if len(gram) > 1 else gram[:0]
            inner = np.flatnonzero(left[: len(gram)] >= k)
            at.append(owner[inner])
            found.append(_mix(gram[inner], 10 + k))
        own = np.flatnonzero(sizes >= k)
        at += [own, own]
        found += [_mix(gram[first[own]], 20 + k), _mix(gram[first[own] + sizes[own] - k], 30 + k)]
    return np.concatenate(at), np.concatenate(found).astype(np.int64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of keys, by the kind of feature."""
    x = (x + np.uint64(kind)) * _STEP
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(64 - 17)


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Scores of distinct words, one row each."""
    out = np.zeros((len(words), len(model.langs)), dtype=np.float32)
    for start in range(0, len(words), 10_000):
        part = words[start : start + 10_000]
        at, ids = features(part, model.lexicon)
        for k in range(out.shape[1]):
            out[start : start + len(part), k] = np.bincount(at, weights=model.weights[ids, k], minlength=len(part))
    return out


def factors(scores: np.ndarray) -> np.ndarray:
    """Emission scores as factors, the largest of a word 1."""
    return np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores


def posteriors(scores: list[np.ndarray], model: Model, pairs: np.ndarray | None = None) -> list[np.ndarray]:
    """Forward-backward over sequences of emission factors, all at once: the share of
    each label at each word. Scaled, so length does not matter. The expected number of
    moves from each label to each is added to ``pairs``."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    steps, count, labels = int(lengths[0]), len(order), len(model.langs)
    e = np.zeros((steps, count, labels), dtype=np.float32)
    for k, i in enumerate(order):
        e[: len(scores[i]), k] = scores[i]
    moves = np.exp(model.moves).astype(np.float32)
    back = np.ascontiguousarray(moves.T)
    ones = np.ones(labels, dtype=np.float32)
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # how many are longer than t
    alpha = np.empty_like(e)
    a = np.exp(model.start).astype(np.float32) * e[0]
    a /= (a @ ones)[:, None]
    alpha[0] = a
    for t in range(1, steps):
        n = active[t]
        a = (a[:n] @ moves) * e[t, :n]
        a /= (a @ ones)[:, None]
        alpha[t, :n] = a
    beta = np.ones((count, labels), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        p = alpha[t, :n]
        p *= beta[:n]
        p /= (p @ ones)[:, None]
        if t:
            after = e[t, :n] * beta[:n]
            if pairs is not None:  # alpha holds the forward shares of t - 1 still
                found = alpha[t - 1, :n, :, None] * moves[None] * after[:, None, :]
                pairs += (found / np.maximum(found.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
            b = after @ back
            beta[:n] = b / (b @ ones)[:, None]
    out: list = [None] * count
    for k, i in enumerate(order):
        out[i] = alpha[: lengths[k], k]
    return out


def train(spans: list[tuple[str, list[str]]], settings: Settings) -> Model | None:
    """AdaGrad on the conditional log-likelihood of sequences made of labelled spans."""
    rng = random.Random(settings.seed)
    by_lang: dict[str, list[list[str]]] = {}
    for lang, words in sorted(spans):
        if words:
            by_lang.setdefault(lang, []).append(words)
    langs = sorted(by_lang)
    if not langs:
        return None
    counts = {lang: Counter(w for s in by_lang[lang] for w in s) for lang in langs}
    lexicon: dict[str, int] = {}
    for k, lang in enumerate(langs):
        for w, _ in sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[: settings.lexicon]:
            lexicon[w] = lexicon.get(w, 0) | (1 << k)
    labels = len(langs)
    model = Model(langs, lexicon, np.zeros((BUCKETS, labels), dtype=np.float32), np.zeros((labels, labels), dtype=np.float32), np.zeros(labels, dtype=np.float32))
    if labels == 1:
        return model
    sequences = []
    for _ in range(settings.sequences):
        parts = 1 if rng.random() < 0.5 else 2
        words, truth = [], []
        for _ in range(parts):
            k = rng.randrange(labels)
            span = rng.choice(by_lang[langs[k]])
            words += span
            truth += [k] * len(span)
        sequences.append((words, np.array(truth)))
    vocabulary = {w: k for k, w in enumerate(sorted({w for s, _ in sequences for w in s}))}
    at, flat = features(list(vocabulary), lexicon)
    by_word = np.argsort(at, kind="stable")
    flat = flat[by_word]
    ends = np.searchsorted(at[by_word], np.arange(len(vocabulary) + 1))
    g2 = np.full((BUCKETS, labels), 1e-3, dtype=np.float32)
    m2, s2 = np.full((labels, labels), 1e-3), np.full(labels, 1e-3)
    for _ in range(settings.epochs):
        rng.shuffle(sequences)
        for low in range(0, len(sequences), settings.batch):
            some = sequences[low : low + settings.batch]
            used, inverse = np.unique(np.concatenate([[vocabulary[w] for w in s] for s, _ in some]), return_inverse=True)
            ids = np.concatenate([flat[ends[w] : ends[w + 1]] for w in used])
            sizes = ends[used + 1] - ends[used]
            rows = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            own = np.add.reduceat(model.weights[ids], rows, axis=0)
            cuts = np.cumsum([len(s) for s, _ in some])[:-1]
            scores = np.split(factors(own)[inverse], cuts)
            grad_moves = np.zeros((labels, labels))
            post = posteriors(scores, model, grad_moves)
            truth = np.eye(labels, dtype=np.float32)
            grad_word = np.zeros_like(own)
            np.add.at(grad_word, inverse, np.concatenate(post) - truth[np.concatenate([t for _, t in some])])
            grad_start = np.zeros(labels)
            for p, (_, t) in zip(post, some, strict=True):
                grad_start += p[0] - truth[t[0]]
                np.add.at(grad_moves, (t[:-1], t[1:]), -1)
            g = np.repeat(grad_word, sizes, axis=0)
            order = np.argsort(ids, kind="stable")
            touched, first = np.unique(ids[order], return_index=True)
            g = np.add.reduceat(g[order], first, axis=0) / len(some) + settings.decay * model.weights[touched]
            g2[touched] += g * g
            model.weights[touched] -= settings.rate * 0.2 * g / np.sqrt(g2[touched])
            for w, gw, acc in ((model.moves, grad_moves / len(some), m2), (model.start, grad_start / len(some), s2)):
                acc += gw * gw
                w -= (settings.rate * 0.2 * gw / np.sqrt(acc)).astype(np.float32)
    model.key = zlib.crc32(model.weights.tobytes())
    return model


def spans_of(settings: Settings):
    schema = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in map(letters_only, words_of(text or "")) if w]
                starts = list(range(0, max(1, len(words) - settings.span_words + 1), settings.span_words))
                rng = random.Random(zlib.crc32((text or "").encode()))
                for at in rng.sample(starts, min(settings.spans_per_doc, len(starts))):
                    if words:
                        rows.append({"lang": lang, "words": words[at : at + settings.span_words]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows a model may learn from: crc32 of the id's text mod 4 is not 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    settings = settings or Settings()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(training_rows(docs, id_col) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, n in sizes.items():
        share = min(1.0, settings.docs_per_lang / n)
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    made = own.filter(keep).select("lang", "text").mapInArrow(released(spans_of(settings)), "lang string, words array<string>")
    bound = 2 * len(sizes) * settings.docs_per_lang * settings.spans_per_doc
    # by a hash, so that the same rows are left out if the bound is met
    model = train([(r[0], r[1]) for r in made.orderBy(F.xxhash64("lang", "words"), "lang", "words").limit(bound).collect()], settings)
    forget(docs.sparkSession)
    return model


_KNOWN = 60_000


class _Chunks(dict):
    """Text between white space -> its word's number: 0 for none, negative for several."""

    def __init__(self, words: dict[str, int]):
        self.words, self.several = words, []

    def __missing__(self, chunk: str) -> int:
        found = [self.words.setdefault(w, len(self.words) + 1) for w in map(letters_only, words_of(chunk)) if w]
        if len(found) > 1:
            self.several.append(np.array(found, dtype=np.int32))
            got = -len(self.several)
        else:
            got = found[0] if found else 0
        self[chunk] = got
        return got


class Scorer:
    """Language and score of texts; keeps the emissions of words it has seen, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.chunks = _Chunks(self.words)
        self.table = np.ones((1, len(self.model.langs)), dtype=np.float32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.chunks) > _KNOWN:
            self.clear()
        get, out = self.chunks.__getitem__, []
        for t in texts:
            chunks = t.split()
            x = np.fromiter(map(get, chunks), dtype=np.int32, count=len(chunks))
            if len(x) and x.min() < 0:
                x = np.concatenate([self.chunks.several[-k - 1] if k < 0 else np.array([k], dtype=np.int32) for k in x.tolist()])
            out.append(x[x > 0])
        new = len(self.words) + 1 - len(self.table)
        if new:
            self.table = np.concatenate([self.table, factors(emissions(list(islice(self.words, len(self.words) - new, None)), self.model))])
        return out

    def shares(self, ids: list[np.ndarray]):
        """Yields (text, first word, shares of the languages at each word from there). A
        long text is a row of windows. Each reads as many words beyond both its ends as
        the learnt transitions need to forget, so its shares are those of the whole chain
        to the precision of the numbers."""
        beyond = memory(self.model)
        words_at_once = max(20_000, 1_000_000 // len(self.model.langs))
        core = max(256, 4 * beyond)
        parts = []
        for i, x in enumerate(ids):
            for at in range(0, len(x), core) if len(x) > core + beyond else ([0] if len(x) else []):
                end = at + core if len(x) > core + beyond else len(x)
                parts.append((i, max(0, at - beyond), at, min(end, len(x)), min(end + beyond, len(x))))
        parts.sort(key=lambda p: p[1] - p[4])
        at = 0
        while at < len(parts):
            n = max(1, words_at_once // (parts[at][4] - parts[at][1]))
            some = parts[at : at + n]
            at += n
            shares = posteriors([self.table[ids[i][low:high]] for i, low, _, _, high in some], self.model)
            for (i, low, start, end, _), p in zip(some, shares, strict=True):
                yield i, start, p[start - low : end - low]

    def labels(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        ids = self.ids([t or "" for t in texts])
        total = np.zeros((len(texts), len(self.model.langs)))
        for i, _, p in self.shares(ids):
            total[i] += p.sum(axis=0, dtype=np.float64)
        out = []
        for x, t in zip(ids, total, strict=True):
            k = int(t.argmax())
            out.append((self.model.langs[k], float(min(1.0, t[k] / len(x)))) if len(x) else (UNKNOWN, 0.0))
        return out

    def word_labels(self, texts: list[str | None]) -> list[list[int]]:
        """The number of each word's likeliest language."""
        ids = self.ids([t or "" for t in texts])
        out = [np.zeros(len(x), dtype=np.int64) for x in ids]
        for i, start, p in self.shares(ids):
            out[i][start : start + len(p)] = p.argmax(axis=1)
        return [x.tolist() for x in out]


def memory(model: Model) -> int:
    """Words after which the chain has forgotten where it began, to one part in 10^8:
    by the contraction of the transitions in Hilbert's metric, whatever the words. A chain
    that never forgets is read as a whole."""
    m = model.moves.astype(np.float64)
    spread = max(0.0, float(np.max(m[:, None, :, None] + m[None, :, None, :] - m[None, :, :, None] - m[:, None, None, :])))
    rate = np.tanh(spread / 4)
    if rate < 1e-3:
        return 1
    return int(np.ceil(np.log(1e-8) / np.log(rate))) if rate < 1 - 1e-9 else 1 << 40


_scorers: dict[int, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One scorer a worker process, until the task ends."""
    if model.key not in _scorers:
        _scorers.clear()
        _scorers[model.key] = Scorer(model)
    return _scorers[model.key]


def forget_scorers() -> None:
    _scorers.clear()


def _judge(shared, batch: pa.RecordBatch, at: int) -> list[tuple[str, float]]:
    if shared.value is None:
        return [(UNKNOWN, 0.0)] * batch.num_rows
    found, own = [], scorer(shared.value)
    for _, texts in text_slices(batch, at):
        found += own.labels(texts)
    return found


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = _judge(shared, batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run, forget_scorers), "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words and labels (arrays) of every document: the likeliest language of each
    word, so where a text switches. Without a model every label is ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.string())), ("labels", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            for low, texts in text_slices(batch, 1):
                words = [[w for c in (t or "").split() for w in map(letters_only, words_of(c)) if w] for t in texts]
                if shared.value is None:
                    labels = [[UNKNOWN] * len(w) for w in words]
                else:
                    labels = [[shared.value.langs[k] for k in found] for found in scorer(shared.value).word_labels(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(texts)), pa.array(words, schema.field(1).type), pa.array(labels, schema.field(2).type)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run, forget_scorers), "doc_id long, words array<string>, labels array<string>")


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, all columns, whose language is known with at least this score;
    a null language becomes the predicted one. Not stored: who reads them more than once
    stores them, so that there is one copy."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        for batch in batches:
            found = _judge(shared, batch, text_at)
            keep = pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_())
            langs = [own if own is not None else got for own, (got, _) in zip(batch.column(lang_at).to_pylist(), found, strict=True)]
            columns = [pa.array(langs, pa.string()) if i == lang_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(released(run, forget_scorers), docs.schema)
