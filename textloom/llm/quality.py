"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, every code point a symbol of its own, of order four, one
for each language, counted on every trusted document. Its tables grow with the trusted
text and stay on the executors: counts of the four orders, their context sums, counts of
counts and discounts are DataFrame aggregates and equi-joins sharded by language and
n-gram, and so is the scoring: the distinct n-grams of all documents get their
probabilities order by order by joins.

Then each document sums its log probabilities. The ``HEAD`` most frequent n-grams, a
fixed number, are summed where the text is. All others go through the sharded join: in
a slice of documents each n-gram lists the documents that hold it, and how often; the
lists are joined with the probabilities by language and n-gram and come back as sums by
document. So no task holds a whole table, and only the head is broadcast.

A document's perplexity is exp of its mean negative log probability per character
over its whole text. Short texts say little, so for the decision it is drawn to the
median of the trusted documents of its language as if by PRIOR_CHARS further
characters (``steady``). A document is kept if its steady perplexity is at most the
``high`` quantile of those trusted documents, widened by ``margin``.

Null or empty text: perplexity null, rejected. Null language: the language "und". A
language without trusted text has no model: perplexity null, kept. Without labels
nothing can be judged and all but empty texts are kept. A document labelled twice is
trusted if no label of it is bad. Equal texts of a language, repeated rows among them,
get equal values. A very long text is read in parts of PART characters. Empty tables
give empty results. Further columns, whatever their names, are not read; keep_good()
returns them unchanged (names that begin with __tl_ are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, forget, in_bitmap, most_frequent, released, scratch, stored

ORDER = 4
#: Code points; an n-gram is two longs, ``hi`` and ``lo``, of two symbols each.
CLASSES = 0x110000
BITS = 21
#: Characters of text that a task looks at together.
PART = 500_000
#: N-grams that are broadcast (32 bytes each).
HEAD = 1 << 18
_MASK = (1 << BITS) - 1
_KEY = ["lang", "hi", "lo"]


def classes(text: str) -> np.ndarray:
    """The symbol of each code point; 0 stands before a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the place of each key among them)."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def keys_of(texts: list[str], before: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo) of the distinct n-grams of non-empty texts; of each character in turn the
    place of its n-gram among them and of its text. ``before`` holds the up to three
    characters that stand before each text."""
    n = ORDER - 1
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    c = np.zeros(sizes.sum() + n * len(texts), dtype=np.int64)
    at = np.arange(len(owner)) + n * (owner + 1)
    c[at] = classes("".join(texts))
    for k, b in enumerate(before or ()):
        if b:
            end = int(sizes[:k].sum()) + n * (k + 1)
            c[end - len(b) : end] = classes(b)
    pairs, which = _distinct((c[:-1] << BITS) | c[1:])
    which = which.astype(np.int64)
    found, gram = _distinct((which[at - 3] << 32) | which[at - 1])
    return pairs[found >> 32], pairs[found & 0xFFFFFFFF], gram, owner


def _parts(batches, columns) -> Iterator[list[tuple]]:
    """Lists of parts (number of the row, first part?, columns.., before, text) of
    together at most about PART characters and 65,536 rows."""
    held, size, number, since = [], 0, -1, 0
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            cut = batch.slice(low, 200)
            for row in zip(*(cut.column(i).to_pylist() for i in columns), strict=True):
                number += 1
                text = row[-1] or ""
                for at in range(0, len(text) or 1, PART):
                    part = text[at : at + PART]
                    if held and (size + len(part) > PART or number - since >= 65_536):
                        yield held
                        held, size = [], 0
                    if not held:
                        since = number
                    held.append((number, at == 0, *row[:-1], text[max(0, at - ORDER + 1) : at], part))
                    size += len(part)
    if held:
        yield held


def _by_lang(parts: list[tuple]) -> dict[str, list[int]]:
    """Places of the parts (.., lang, before, text) with text."""
    out: dict[str, list[int]] = {}
    for i, part in enumerate(parts):
        if part[-1]:
            out.setdefault(part[-3], []).append(i)
    return out


def _counts(batches):
    """(lang, hi, lo, c), added up over parts while they are few."""

    def flush():
        for lang, found in held.items():
            hi, lo, c = (np.concatenate(x) for x in zip(*found, strict=True))
            _, h = _distinct(hi)
            _, w = _distinct(lo)
            key, which = _distinct((h.astype(np.int64) << 32) | w)
            first = np.zeros(len(key), dtype=np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            total = np.bincount(which, c, len(key)).astype(np.int64)
            for low in range(0, len(key), 50_000):
                cut = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first[cut]), pa.string()), pa.array(hi[first[cut]]), pa.array(lo[first[cut]]), pa.array(total[cut])], names=[*_KEY, "c"])

    held: dict[str, list] = {}
    size = 0
    for parts in _parts(batches, (0, 1)):
        for lang, places in _by_lang(parts).items():
            hi, lo, gram, _ = keys_of([parts[i][-1] for i in places], [parts[i][-2] for i in places])
            held.setdefault(lang, []).append((hi, lo, np.bincount(gram, minlength=len(hi))))
            size += len(hi)
        if size > 700_000:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def _ngrams(df: DataFrame) -> DataFrame:
    """(lang, hi, lo, c): how often each n-gram is in the texts of (lang, text)."""
    return df.select("lang", "text").mapInArrow(released(_counts), "lang string, hi long, lo long, c long").groupBy(_KEY).agg(F.sum("c").alias("c"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents whose labels are all good."""
    return labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


def trusted_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(lang, text) of the trusted documents. A bitmap of the ids' hashes first drops
    nearly all others, so that only about the trusted texts are shuffled for the exact
    join (a merge join, which the optimizer does not move below the bitmap's)."""
    near = in_bitmap(docs.filter("doc_id is not null and text is not null"), "doc_id", ids).filter("__tl_near")
    return near.select("doc_id", "lang", "text").join(ids.hint("merge"), "doc_id").select("lang", "text")


def _discounts(counted: DataFrame) -> DataFrame:
    """d1, d2, d3 of each language from its counts of counts."""
    n = [F.sum(F.when(F.col("c") == k, 1.0).otherwise(0.0)).alias(f"n{k}") for k in (1, 2, 3, 4)]
    t = counted.groupBy("lang").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(k, low, high):
        found = F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.lit(float(k)) - F.lit(k + 1.0) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)))
        return F.least(F.greatest(F.coalesce(found, F.lit(k - 0.5)), F.lit(low)), F.lit(high)).alias(f"d{k}")

    return t.select("lang", d(1, 0.05, 0.95), d(2, 0.1, 1.9), d(3, 0.2, 2.8))


def _context():
    """(hi, lo) of what stands before the last symbol."""
    return F.shiftright("hi", BITS), F.shiftleft(F.col("hi").bitwiseAND(F.lit(_MASK)), BITS).bitwiseOR(F.shiftright("lo", BITS))


def _ending(order: int):
    """(hi, lo) of the last ``order`` symbols, of an n-gram one longer."""
    return [F.col("hi").bitwiseAND(F.lit(_MASK if order == 3 else 0)), F.col("lo").bitwiseAND(F.lit(_MASK)) if order == 1 else F.col("lo")]


def _order(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, hi, lo, a): discounted shares; (lang, h_hi, h_lo, g): weight left to the
    lower order."""
    before, last = _context()
    counted = counted.select(*_KEY, before.alias("h_hi"), last.alias("h_lo"), "c")
    context = ["lang", "h_hi", "h_lo"]
    sums = counted.groupBy(context).agg(
        F.sum("c").alias("s"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("m1"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("m2"), F.sum(F.when(F.col("c") > 2, 1).otherwise(0)).alias("m3")
    )
    # one row a language
    cut = stored(_discounts(counted), "discounts")
    less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    share = counted.join(sums, context).join(cut, "lang").select(*_KEY, (F.greatest(F.col("c") - less, F.lit(0.0)) / F.col("s")).alias("a"))
    weight = sums.join(cut, "lang").select(*context, ((F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("s")).alias("g"))
    return share, weight


def fit(docs: DataFrame, labels: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Shares and weights by order, from 1 on, from all trusted documents."""
    own = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    by_order = [stored(_ngrams(trusted_text(own, trusted_ids(labels))), "ngrams")]
    for order in range(ORDER - 1, 0, -1):
        # how many different symbols stand before the shorter n-gram
        hi, lo = _ending(order)
        by_order.insert(0, stored(by_order[0].groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("c")), "ngrams"))
    return [_order(counted) for counted in by_order]


def probabilities(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, hi, lo, c, p) of the distinct n-grams (lang, hi, lo, c) wanted whose
    language has a model."""
    asked = [wanted]
    for order in range(ORDER - 1, 0, -1):
        hi, lo = _ending(order)
        asked.insert(0, asked[0].select("lang", hi.alias("hi"), lo.alias("lo")).distinct())
    below = None
    before, last = _context()
    for order, (own, (share, weight)) in enumerate(zip(asked, model, strict=True), 1):
        kept = own.columns
        made = own.select(*kept, before.alias("h_hi"), last.alias("h_lo")).join(share, _KEY, "left").join(weight, ["lang", "h_hi", "h_lo"], "inner" if order == 1 else "left")
        if below is None:
            made = made.withColumn("b", F.lit(1.0 / CLASSES))
        else:
            hi, lo = _ending(order - 1)
            made = made.withColumns({"e_hi": hi, "e_lo": lo}).join(below.select("lang", F.col("hi").alias("e_hi"), F.col("lo").alias("e_lo"), F.col("p").alias("b")), ["lang", "e_hi", "e_lo"])
        below = made.select(*kept, (F.coalesce("a", F.lit(0.0)) + F.coalesce("g", F.lit(1.0)) * F.col("b")).alias("p"))
    return below


def _mixed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    x = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Head:
    """Log probabilities of the most frequent n-grams, by language."""

    def __init__(self, rows: pa.Table):
        self.by_lang: dict[str, tuple] = {}
        langs = np.array(rows.column(0).to_pylist(), dtype=object)
        hi, lo, p = (rows.column(i).to_numpy() for i in (1, 2, 3))
        for lang in set(langs.tolist()):
            own = np.flatnonzero(langs == lang)
            key = _mixed(hi[own], lo[own])
            own = own[np.argsort(key, kind="stable")]
            self.by_lang[lang] = (np.sort(key), hi[own], lo[own], np.log(p[own]))

    def find(self, lang: str, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is here, its log probability or 0) of each n-gram."""
        if lang not in self.by_lang:
            return np.zeros(len(hi), dtype=bool), np.zeros(len(hi))
        key, own_hi, own_lo, logs = self.by_lang[lang]
        at = np.minimum(np.searchsorted(key, _mixed(hi, lo)), len(key) - 1)
        here = (own_hi[at] == hi) & (own_lo[at] == lo)
        return here, np.where(here, logs[at], 0.0)


_HELD = "hi long, lo long, base long, texts binary, times binary, row long, total double, doc_id long, lang string, n_chars long, content binary"
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def _lists(shared):
    """A row for each part of a document, with its sum over the head, and for each other
    n-gram the places of the documents that hold it (two bytes each, from ``base``) and
    how often (one byte; more often than 255 times is several places)."""
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _HELD.split(", ")])

    def rows_of(n, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        head = shared.value
        part_number = 0
        for parts in _parts(batches, (0, 1, 2, 3)):
            since = parts[0][0]
            base = first + since
            total: list[float | None] = [None] * len(parts)
            for lang, places in _by_lang(parts).items():
                hi, lo, gram, owner = keys_of([parts[i][-1] for i in places], [parts[i][-2] for i in places])
                here, logs = head.find(lang, hi, lo)
                known = here[gram]
                some = np.bincount(owner, minlength=len(places), weights=np.where(known, logs[gram], 0.0))
                for i, value, n in zip(places, some.tolist(), np.bincount(owner[known], minlength=len(places)).tolist(), strict=True):
                    total[i] = value if n else None
                document = np.array([parts[i][0] - since for i in places])
                rest = ~known
                held, times = np.unique(gram[rest].astype(np.int64) * 65536 + document[owner[rest]], return_counts=True)
                if not len(held):
                    continue
                more = -(-times // 255)
                if more.max() > 1:
                    last = np.cumsum(more) - 1
                    left, held = times - 255 * (more - 1), np.repeat(held, more)
                    times = np.full(len(held), 255)
                    times[last] = left
                used, starts = np.unique(held >> 16, return_index=True)
                ends = np.append(starts, len(held))
                for low in range(0, len(used), 20_000):
                    high = min(low + 20_000, len(used))
                    cut = slice(ends[low], ends[high])
                    offsets = ends[low : high + 1] - ends[low]
                    binary = lambda raw, width: pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])  # noqa: B023, E731
                    yield rows_of(
                        high - low, hi=pa.array(hi[used[low:high]]), lo=pa.array(lo[used[low:high]]), base=pa.array(np.full(high - low, base)),
                        texts=binary((held[cut] & 65535).astype("<u2"), 2), times=binary(times[cut].astype(np.uint8), 1), lang=pa.array([lang] * (high - low), pa.string()),
                    )
            n = len(parts)
            # no n-gram has these keys, which deal the documents
            yield rows_of(
                n, hi=pa.array([-1] * n, pa.int64()), lo=pa.array([-1 - first - part_number - i for i in range(n)], pa.int64()), row=pa.array([first + p[0] for p in parts], pa.int64()), total=pa.array(total, pa.float64()),
                doc_id=pa.array([p[2] if p[1] else None for p in parts], pa.int64()), lang=pa.array([p[4] for p in parts], pa.string()), n_chars=pa.array([len(p[-1]) for p in parts], pa.int64()), content=pa.array([p[3] if p[1] else None for p in parts], pa.binary()),
            )
            part_number += n

    return run


_SUMS = "row long, total double, doc_id long, lang string, n_chars long, content binary"


def _sums(batches):
    """The documents as they come, and sums of log probabilities by document."""
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _SUMS.split(", ")])

    def flush(rows, sums):
        row, which = np.unique(np.concatenate(rows), return_inverse=True)
        return row, np.bincount(which, np.concatenate(sums), len(row))

    def out(row, total):
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(total), *(pa.nulls(len(row), f.type) for f in list(schema)[2:])], schema=schema)

    rows, sums, size = [], [], 0
    for batch in batches:
        documents = batch.filter(pa.compute.is_null(batch.column(1)))
        if documents.num_rows:
            yield pa.RecordBatch.from_arrays(documents.columns[4:], schema=schema)
        lists = batch.filter(pa.compute.is_valid(batch.column(1)))
        if not lists.num_rows:
            continue
        places = np.frombuffer(b"".join(lists.column(1).to_pylist()), dtype="<u2").astype(np.int64)
        times = np.frombuffer(b"".join(lists.column(2).to_pylist()), dtype=np.uint8)
        many = pa.compute.binary_length(lists.column(2)).to_numpy()
        row, total = flush([np.repeat(lists.column(0).to_numpy(), many) + places], [np.repeat(np.log(lists.column(3).to_numpy()), many) * times])
        rows.append(row)
        sums.append(total)
        size += len(row)
        if size > 1_000_000:
            row, total = flush(rows, sums)
            rows, sums, size = [row], [total], len(row)
            if size > 500_000:
                yield out(row, total)
                rows, sums, size = [], [], 0
    if rows:
        yield out(*flush(rows, sums))


def score(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], head: int = HEAD) -> DataFrame:
    """doc_id, lang, n_chars, perplexity of every document, and the MD5 of its text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("content"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    asked = stored(_ngrams(own), "asked")
    known = stored(probabilities(asked, model), "probabilities")
    drop_stored(asked)
    forget(docs.sparkSession)
    top = known.filter(most_frequent(known, "c", head)).select(*_KEY, "p").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Head(top))
    held = own.mapInArrow(released(_lists(shared)), _HELD).join(known.select(*_KEY, "p").hint("merge"), _KEY, "left")
    # a list without a probability is of a language without a model
    held = held.filter("texts is null or p is not null").select("base", "texts", "times", "p", "row", "total", "doc_id", "lang", "n_chars", "content")
    summed = {"total": F.sum("total"), "n_chars": F.sum("n_chars")}
    rows = held.mapInArrow(released(_sums), _SUMS).groupBy("row").agg(*(summed.get(c, F.max(c)).alias(c) for c in ("total", "doc_id", "lang", "n_chars", "content")))
    return rows.select("doc_id", "lang", "n_chars", F.exp(-F.col("total") / F.col("n_chars")).alias("perplexity"), "content")


HIGH, MARGIN, PRIOR_CHARS = 0.998, 0.05, 40


def thresholds(scored: DataFrame, labels: DataFrame, high: float, margin: float) -> DataFrame:
    """(lang, middle, most) from the trusted documents of each language."""
    own = scored.filter("perplexity is not null").join(trusted_ids(labels), "doc_id", "left_semi")
    middle = own.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(0.5), F.lit(10_000)).alias("middle"))
    steady = own.join(F.broadcast(middle), "lang").withColumn("steady", _steady(F.col("perplexity"), F.col("n_chars"), F.col("middle")))
    return steady.groupBy("lang").agg(F.first("middle").alias("middle"), (F.percentile_approx("steady", F.lit(high), F.lit(10_000)) * (1 + margin)).alias("most"))


def _steady(perplexity, n, middle):
    return F.exp((n * F.log(perplexity) + PRIOR_CHARS * F.log(middle)) / (n + PRIOR_CHARS))


def _judged(docs: DataFrame, labels: DataFrame, high: float, margin: float) -> DataFrame:
    with scratch(docs.sparkSession) as hold:
        scored = hold(stored(score(docs, fit(docs, labels)), "perplexity"))
    forget(docs.sparkSession)
    out = scored.join(stored(thresholds(scored, labels, high, margin), "thresholds"), "lang", "left").withColumn("steady", _steady(F.col("perplexity"), F.col("n_chars"), F.col("middle")))
    keep = (F.col("n_chars") > 0) & (F.col("steady").isNull() | (F.col("steady") <= F.col("most")))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "steady", "most", keep.alias("keep"), "content")


def classify(docs: DataFrame, labels: DataFrame, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, steady, most, keep of every document."""
    return _judged(docs, labels, high, margin).drop("content")


def keep_good(docs: DataFrame, labels: DataFrame, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """The documents, all columns, that classify() keeps: equal texts of a language are
    judged alike, so the rejected ones are known by language and MD5. Only rows that a
    bitmap of those does not clear are shuffled."""
    key = lambda lang, content: F.concat(lang, F.lit(":"), content)
    with scratch(docs.sparkSession) as hold:
        bad = hold(stored(_judged(docs, labels, high, margin).filter(~F.col("keep")).select(key(F.col("lang"), F.lower(F.hex("content"))).alias("__tl_key")).distinct(), "rejected"))
    own = docs.withColumn("__tl_key", key(F.coalesce(F.col("lang"), F.lit("und")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    marked = in_bitmap(own, "__tl_key", bad)
    # an outer join: an anti join would be moved below the bitmap's, to all rows
    near = marked.filter("__tl_near").join(bad.withColumn("__tl_bad", F.lit(True)), "__tl_key", "left").filter("__tl_bad is null")
    return marked.filter(~F.col("__tl_near")).select(docs.columns).unionByName(near.select(docs.columns))
