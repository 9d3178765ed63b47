"""SentencePiece encoding and decoding over a relational lattice.

Text is normalised as the model says (a space becomes U+2581, one stands before the
text), and cut into words: wherever two neighbouring characters stand side by side in no
piece, no piece crosses, so that no path of the lattice does. Only distinct words are
encoded:

1. every substring of at most the longest piece's length is exploded,
2. joined to the piece table by equality (32,000 rows, a fixed table, broadcast),
3. grouped to the word's edges (start, end, id, score), sorted by end,
4. folded by ``aggregate`` to the ids. A character without a piece becomes its bytes'
   pieces.

The fold is that of the model's kind. ``unigram``: Viterbi, the best score and edge at
each end, then back along the best path; of equal paths the one whose last piece is
longer. ``bpe``: the edges in order of score, of equal ones the leftmost first; an edge
that spans just two neighbouring parts joins them. One pass is exact, as no piece of such
a model is made by joins of falling score (``falling`` lists pieces that are; words that
hold one, and words of more than LONG_WORD characters, whose places do not fit the
fold's bits, take the joins one by one with a heap, in Arrow batches). Viterbi over a BPE
model's scores (ranks) is the best path of the lattice too, but not the ids that the
library gives. So the query takes both through to the end: the digest of the ids on
Viterbi's path, traced back and decoded again, stands beside that of the library's ids.

``encode_documents`` gives each document its ids in order. For ``encode_digest`` the
``head`` most frequent words (a fixed number, broadcast as 64-bit hashes and numbers) are
looked up where the text is; other words' places are joined with the encoded vocabulary
by hash and come back as sums by document, so no text is shuffled. Every distinct word is
decoded again; a document's round trip holds if all its words' do.

Null and empty text: no pieces. Repeated rows count each. A null id is kept. An empty
table gives an empty result. Very long words and texts work; a word's lattice grows
linearly with it. Further columns, whatever their names, are not read. Two words are
taken for one only if their 64-bit hashes collide.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, drop_stored, hashes, most_frequent, released, shuffle_partitions, stored, text_slices

SPACE = "▁"
#: Places count as powers of a primitive root of this prime.
_DIGEST, _ROOT = 2147483647, 16807


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pieces_of(model) -> list[tuple[str, int, float]]:
    """(piece, id, score) of ordinary pieces."""
    return [(model.id_to_piece(i), i, float(model.get_score(i))) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def piece_table(spark: SparkSession, path: str) -> tuple[DataFrame, int, float, int]:
    """(piece, id, score) of ordinary pieces, the longest's length, the score of a
    character without a piece, and the id of byte 0."""
    model = load(path)
    rows = pieces_of(model)
    # as the library does, a missing character costs 10 more than the worst ordinary piece
    worst = min(score for _, _, score in rows) - 10.0
    return spark.createDataFrame(rows, "piece string, id int, score double"), max(len(r[0]) for r in rows), worst, model.piece_to_id("<0x00>")


class Cutter:
    """Cuts texts into words between which no piece can lie, and hashes the words."""

    def __init__(self, pieces: list[str]):
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        place = {c: k + 1 for k, c in enumerate(chars)}
        self.kind = np.zeros(0x110000, dtype=np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p in pieces:
            for a, b in zip(p, p[1:]):
                self.joined[place[a], place[b]] = True

    def words(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all texts as one, each word's start, end, hash and text)."""
        own = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(own)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.kind[code]
        cut = np.ones(len(code) + 1, dtype=bool)
        if len(code):
            cut[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        ends = np.cumsum([len(t) for t in own])
        cut[ends[:-1]] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        return whole, start, end, hashes(code, start, end), np.searchsorted(ends, start, side="right")


#: Bytes of text that are looked at together.
_FIT = 1 << 19


def words_of(text: str, pieces: list[str]) -> list[str]:
    """The words of one text; they join to its normalised form."""
    whole, start, end, _, _ = Cutter(pieces).words([text])
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _counted(pieces: list[str]):
    def run(batches):
        cutter, index, words, counts = Cutter(pieces), {}, [], np.zeros(1 << 16, dtype=np.int64)

        def flush():
            for low in range(0, len(words), 20_000):
                part = words[low : low + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([w for _, w in part], pa.string()), pa.array(counts[low : low + len(part)])], names=["key", "word", "n"])

        for batch in batches:
            for _, texts in text_slices(batch, 0, 2 * _FIT):
                whole, start, end, h, _ = cutter.words(texts)
                if not len(h):
                    continue
                key, first, which = distinct(h)
                slots = np.empty(len(key), dtype=np.int64)
                for k, (x, at) in enumerate(zip(key.tolist(), first.tolist(), strict=True)):
                    slot = index.get(x)
                    if slot is None:
                        slot = index[x] = len(words)
                        words.append((x, whole[start[at] : end[at]]))
                    slots[k] = slot
                if len(words) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(words)), dtype=np.int64)])
                counts[slots] += np.bincount(which, minlength=len(key))
                if len(words) > 200_000:
                    yield from flush()
                    index, words, counts = {}, [], np.zeros(1 << 16, dtype=np.int64)
        yield from flush()

    return released(run)


def vocabulary(docs: DataFrame, pieces: list[str], text_col: str = "text") -> DataFrame:
    """(key, word, n) of every distinct word of the texts."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counted(pieces), "key long, word string, n long")
    return counted.groupBy("key").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def lattice(words: DataFrame, pieces: DataFrame, longest: int, missing: float) -> DataFrame:
    """(word, edges) with edges sorted by end, then by start descending."""
    cut = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("s"))
    cut = cut.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("word") - F.col("s") + 1))).alias("k"))
    cut = cut.select("word", (F.col("s") - 1).alias("s"), "k", F.substring(F.col("word"), F.col("s"), F.col("k")).alias("piece"))
    found = cut.join(F.broadcast(pieces), "piece", "left").filter(F.col("id").isNotNull() | (F.col("k") == 1))
    edge = F.struct((F.col("s") + F.col("k")).alias("e"), F.col("s").alias("s"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(missing)).alias("score"))
    return found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(edges):
    """The best entry at each end: (score, start of its last piece, that piece's id). The
    ends come in order, so an edge either opens the next end or competes for the last."""
    entry = lambda score, s, i: F.struct(score.alias("score"), s.alias("s"), i.alias("id"))
    start = F.array(entry(F.lit(0.0), F.lit(-1), F.lit(-1)))

    def relax(best, edge):
        score = F.element_at(best, edge["s"] + 1)["score"] + edge["score"]
        made = F.array(entry(score, edge["s"], edge["id"]))
        return F.when(edge["e"] >= F.size(best), F.concat(best, made)).when(score > F.element_at(best, -1)["score"], F.concat(F.slice(best, 1, F.size(best) - 1), made)).otherwise(best)

    return F.aggregate(edges, start, relax)


def trace(best):
    """The path's (start, id) pairs in order, followed back from the end; -1 stands for a
    character without a piece."""
    init = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<struct<s:int,id:int>>").alias("path"))

    def step(state, _):
        here = F.element_at(best, state["at"] + 1)
        return F.when(state["at"] <= 0, state).otherwise(F.struct(here["s"].alias("at"), F.concat(state["path"], F.array(F.struct(here["s"].alias("s"), here["id"].alias("id")))).alias("path")))

    return F.reverse(F.aggregate(best, init, step, lambda x: x["path"]))


#: The cuts of a word are bits of a long.
LONG_WORD = 60
_WORDS_A_TASK = 12_000


def _bit(k):
    return F.call_function("shiftleft", F.expr("1L"), k)


def merges(edges, size):
    """(start, id) of the parts that a word of ``size`` characters ends in."""
    inner = lambda x: _bit(x["e"]) - _bit(x["s"] + 1)
    joins = F.filter(edges, lambda x: (x["e"] - x["s"] > 1) & (x["id"] >= 0))
    joins = F.sort_array(F.transform(joins, lambda x: F.struct((-x["score"]).alias("after"), x["s"].alias("s"), (_bit(x["s"]) + _bit(x["e"])).alias("ends"), inner(x).alias("inner"))))

    def step(cuts, x):
        spans_two = (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inner"])) == 1)
        return F.when(spans_two, cuts.bitwiseAND(F.bitwise_not(x["inner"]))).otherwise(cuts)

    cuts = F.aggregate(joins, _bit(size + 1) - 1, step)
    here = lambda x, c: (c.bitwiseAND(_bit(x["s"]) + _bit(x["e"])) == _bit(x["s"]) + _bit(x["e"])) & (c.bitwiseAND(inner(x)) == 0)
    path = lambda c: F.transform(F.filter(edges, lambda x: here(x, c)), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))
    # an array of one value binds the cuts once
    return F.flatten(F.transform(F.array(cuts), path))


def merge_word(size: int, edges: list[tuple[int, int, int, float]]) -> tuple[list[tuple[int, int]], list[float]]:
    """merges() of one word by a heap, whatever the order of scores: the parts, and the
    scores of the joins in turn; edges are (end, start, id, score)."""
    import heapq

    table = {(s, e): (score, i) for e, s, i, score in edges}
    after = list(range(1, size + 1))  # end of the part that starts here
    before = list(range(-1, size))  # start of the part that ends here
    live = [True] * size
    heap = [(-table[k, k + 2][0], k, k + 1, k + 2) for k in range(size - 1) if (k, k + 2) in table]
    heapq.heapify(heap)
    done = []
    while heap:
        score, s, mid, e = heapq.heappop(heap)
        if not (live[s] and after[s] == mid and mid < size and live[mid] and after[mid] == e):
            continue
        done.append(-score)
        live[mid] = False
        after[s] = e
        before[e] = s
        if e < size and (s, after[e]) in table:
            heapq.heappush(heap, (-table[s, after[e]][0], s, e, after[e]))
        left = before[s] if s else -1
        if left >= 0 and (left, e) in table:
            heapq.heappush(heap, (-table[left, e][0], left, s, e))
    return [(s, table[s, after[s]][1]) for s in range(size) if live[s]], done


def falling(pieces: list[tuple[str, int, float]]) -> list[str]:
    """Pieces that joins one by one reach with a better score after a worse one. Inside a
    piece, joins come in the same order in any word, so without such pieces the scores of
    all joins of any word never rise, and one pass in order of score finds them."""
    known = {p: (i, score) for p, i, score in pieces}
    out = []
    for p, _, _ in pieces:
        if len(p) > 2:
            edges = [(e, s, *known[p[s:e]]) for s in range(len(p)) for e in range(s + 1, len(p) + 1) if p[s:e] in known]
            edges += [(k + 1, k, -1, 0.0) for k, c in enumerate(p) if c not in known]
            path, scores = merge_word(len(p), edges)
            if len(path) == 1 and any(b > a for a, b in zip(scores, scores[1:])):
                out.append(p)
    return out


def _merge_each(batches):
    schema = pa.schema([("word", pa.string()), ("edges", _EDGES), ("path", pa.list_(pa.struct([("s", pa.int32()), ("id", pa.int32())])))])
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            cut = batch.slice(low, 256)
            paths = [[{"s": s, "id": i} for s, i in merge_word(len(word), [(x["e"], x["s"], x["id"], x["score"]) for x in edges])[0]] for word, edges in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1).cast(_EDGES), pa.array(paths, schema.field("path").type)], schema=schema)


_EDGES = pa.list_(pa.struct([("e", pa.int32()), ("s", pa.int32()), ("id", pa.int32()), ("score", pa.float64())]))
_EDGES_SQL = "array<struct<e:int,s:int,id:int,score:double>>"


def encode_words(words: DataFrame, pieces: DataFrame, longest: int, missing: float, byte0: int, kind: str = "bpe", odd: tuple[str, ...] = (), both: bool = False) -> DataFrame:
    """(word, ids) of distinct words; ``odd`` are falling() pieces of a BPE model. With
    ``both``, ``best`` holds the ids on Viterbi's path."""
    made = lattice(words.select("word"), pieces, longest, missing)
    # an array of one value binds the table once; trace() reads it at every step
    best = F.flatten(F.transform(F.array(viterbi(F.col("edges"))), trace))
    hexes = lambda x: F.hex(F.encode(F.substring(F.col("word"), x["s"] + 1, F.lit(1)), "UTF-8"))
    as_bytes = lambda x: F.transform(F.sequence(F.lit(1), F.length(hexes(x)), F.lit(2)), lambda i: (F.conv(F.substring(hexes(x), i, F.lit(2)), 16, 10).cast("int") + byte0))
    mixed = lambda path: F.flatten(F.transform(path, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(as_bytes(x))))
    ids = lambda path: F.when(F.exists("edges", lambda x: x["id"] < 0), mixed(path)).otherwise(F.transform(path, lambda x: x["id"]))
    if kind == "unigram":
        made = made.withColumn("path", best)
    else:
        size = F.char_length("word")
        far = size > LONG_WORD
        for piece in odd:
            far = far | F.col("word").contains(piece)
        short = made.filter(~far).withColumn("path", merges(F.col("edges"), size))
        # the long ones' lattices are made apart, so that few rows reach the workers
        long = lattice(words.filter(far).select("word"), pieces, longest, missing)
        made = short.unionByName(long.mapInArrow(_merge_each, f"word string, edges {_EDGES_SQL}, path array<struct<s:int,id:int>>"))
    if both:
        made = made.withColumn("best", F.col("path") if kind == "unigram" else best)
    return made.select("word", *(ids(F.col(x)).alias(y) for x, y in (("path", "ids"), ("best", "best"))[: 1 + both]))


def decoder(model) -> list[bytes]:
    """The bytes of each id: U+2581 is a space."""
    return [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(model.get_piece_size())]


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """encoded with the text of its ids: pieces joined, bytes gathered, U+2581 a space.
    The space before the text is the caller's to take off (``words`` have it)."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        model = load(path)
        schema = to_arrow_schema(encoded_schema)
        table = decoder(model)
        at = encoded_columns.index(ids_col)
        for batch in batches:
            texts = [b"".join([table[i] for i in ids or []]).decode("utf-8", "replace") for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    from pyspark.sql.types import StringType, StructField, StructType

    encoded_columns = encoded.columns
    encoded_schema = StructType([*encoded.schema.fields, StructField(out, StringType())])
    return encoded.mapInArrow(run, encoded_schema)


_ENCODED = "key long, ids array<int>, n int, crc long, same boolean, n_best int, best_crc long, best_same boolean"


def _checked(path: str):
    """Adds each word's number of ids, their crc32, and whether they decode to the word, and
    the same of the ids on Viterbi's path, which may be null."""
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _ENCODED.split(", ")])

    def looked(words, lists, table):
        flat, ends = lists.flatten().to_numpy().astype("<i4"), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        raw, ids = flat.tobytes(), flat.tolist()
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans]
        same = [b"".join([table[i] for i in ids[a:b]]) == w for w, (a, b) in zip(words, spans, strict=True)]
        return [pa.array(np.diff(ends).astype(np.int32)), pa.array(crc, pa.int64()), pa.array(same)]

    def run(batches):
        table = decoder(load(path))
        for batch in batches:
            words, lists, best = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            plain = [w.replace(SPACE, " ").encode() for w in words]
            viterbis = looked(plain, best, table) if not best.null_count else [pa.nulls(len(words), t) for t in (pa.int32(), pa.int64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(hash_words(words)), lists.cast(pa.list_(pa.int32())), *looked(plain, lists, table), *viterbis], schema=schema)

    return released(run)


def encoded_vocabulary(docs: DataFrame, path: str, kind: str = "bpe", both: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, n) of the distinct words of (text), and what _checked() tells of each."""
    spark = docs.sparkSession
    rows = pieces_of(load(path))
    pieces, longest, missing, byte0 = piece_table(spark, path)
    words = stored(vocabulary(docs, [r[0] for r in rows]), "words")
    # dealt by word, so that the lattice's edges are grouped where they are made; with
    # so few words a task, and the threshold above them, grouping does not sort
    fallback = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(fallback)
    spark.conf.set(fallback, str(10 * _WORDS_A_TASK))
    try:
        dealt = words.select("key", "word").repartition(max(shuffle_partitions(spark), -(-words.count() // _WORDS_A_TASK)), "word")
        made = encode_words(dealt, pieces, longest, missing, byte0, kind, tuple(falling(rows)) if kind == "bpe" else (), both)
        made = made.select("word", "ids", F.col("best") if both else F.lit(None).cast("array<int>").alias("best"))
        encoded = stored(made.mapInArrow(_checked(path), _ENCODED), "encoded")
    finally:
        spark.conf.set(fallback, before)
    return words, encoded


def hash_words(words: list[str]) -> np.ndarray:
    """Cutter's hashes of whole words."""
    size = np.array([len(w) for w in words])
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    end = np.cumsum(size)
    return hashes(code, end - size, end)


class _Head:
    """Numbers of the most frequent words, by hash."""

    def __init__(self, found: pa.Table):
        key = found.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.columns = {c: np.append(found.column(c).to_numpy()[order], 0).astype(np.int64) for c in ("n", "crc", "same", "n_best", "best_crc", "best_same")}
        for c in ("crc", "best_crc"):
            self.columns[c] %= _DIGEST

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = np.searchsorted(self.key[:-1], key)
        return np.where(self.key[at] == key, at, -1)


_PLACED = "row long, doc_id long, n_words long, n long, digest long, n_best long, best_digest long, same boolean, best_same boolean, place long, key long"


def place_weight(places: np.ndarray) -> np.ndarray:
    """_ROOT to the power of each place, modulo _DIGEST."""
    out, base, left = np.ones(len(places), dtype=np.int64), _ROOT, places.astype(np.int64) % (_DIGEST - 1)
    while left.any():
        out = np.where(left & 1, out * base % _DIGEST, out)
        base, left = base * base % _DIGEST, left >> 1
    return out


def _placed(shared, pieces: list[str]):
    """Per document the sums over its head words; a row for each other word's place."""
    types = {"long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _PLACED.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        head, cutter, near = shared.value, Cutter(pieces), place_weight(np.arange(_FIT))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, texts in text_slices(batch, 1, _FIT):
                whole, start, end, h, owner = cutter.words(texts)
                n = len(texts)
                n_words = np.bincount(owner, minlength=n)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
                key, _, which = distinct(h)
                at = head.find(key)[which]
                weight = near[place] if place.max(initial=0) < len(near) else place_weight(place)
                # sums of integers below 2^53, which bincount adds exactly
                of = head.columns
                sums = [np.bincount(owner, x, n) for x in (of["n"][at], of["crc"][at] * weight % _DIGEST, of["n_best"][at], of["best_crc"][at] * weight % _DIGEST)]
                same = [np.bincount(owner, (at >= 0) & (of[c][at] == 0), n) == 0 for c in ("same", "best_same")]
                rest = np.flatnonzero(at < 0)
                null = lambda t: pa.nulls(len(rest), t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row + np.arange(n), row + owner[rest]])), pa.concat_arrays([batch.column(0).slice(low, n).cast(pa.int64()), null(pa.int64())]),
                        *(pa.concat_arrays([pa.array(x.astype(np.int64)), null(pa.int64())]) for x in (n_words, *sums)), *(pa.concat_arrays([pa.array(x), null(pa.bool_())]) for x in same),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(weight[rest])]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(h[rest])]),
                    ],
                    schema=schema,
                )
                row += n

    return released(run)


def encode_digest(docs: DataFrame, path: str, head: int = 1 << 18, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces, n_viterbi, ids_digest, round_trip, viterbi_digest and
    viterbi_round_trip of every document. A digest sums crc32 of each word's ids times a
    root to the power of the word's place, modulo the prime 2^31 - 1, so words in another
    order give another digest. Those of Viterbi's path are over the ids that
    encode_documents() gives for the kind ``unigram``."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words, encoded = encoded_vocabulary(own, path, kind)
    pieces = [r[0] for r in pieces_of(load(path))]
    flag = lambda c: F.col(c).cast("int").alias(c)
    top = words.filter(most_frequent(words, "n", head)).select("key").join(encoded.select("key", "n", "crc", flag("same"), "n_best", "best_crc", flag("best_same")), "key").toArrow()
    shared = spark.sparkContext.broadcast(_Head(top))
    drop_stored(words)
    placed = stored(own.mapInArrow(_placed(shared, pieces), _PLACED), "placed")
    by_word = encoded.select("key", *(F.col(c).alias(f"w_{c}") for c in ("n", "crc", "same", "n_best", "best_crc", "best_same")))
    rest = placed.filter("key is not null").select("row", "place", "key").join(by_word, "key")
    digest = lambda c: F.sum(F.col(c) % _DIGEST * F.col("place") % _DIGEST)
    rest = rest.groupBy("row").agg(
        F.sum("w_n").alias("more"), digest("w_crc").alias("more_digest"), F.min("w_same").alias("more_same"),
        F.sum("w_n_best").alias("more_best"), digest("w_best_crc").alias("more_best_digest"), F.min("w_best_same").alias("more_best_same"),
    )
    docs_ = placed.filter("key is null").drop("place", "key").withColumnRenamed("row", "r")
    out = docs_.join(rest, docs_["r"] == rest["row"], "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    both = lambda a, b: F.col(a) & F.coalesce(b, F.lit(True))
    return out.select(
        "doc_id", "n_words", plus("n", "more").alias("n_pieces"), plus("n_best", "more_best").alias("n_viterbi"),
        (plus("digest", "more_digest") % _DIGEST).alias("ids_digest"), both("same", "more_same").alias("round_trip"),
        (plus("best_digest", "more_best_digest") % _DIGEST).alias("viterbi_digest"), both("best_same", "more_best_same").alias("viterbi_round_trip"),
    )


def _keyed(pieces: list[str]):
    def run(batches):
        from pyspark import TaskContext

        cutter, row = Cutter(pieces), TaskContext.get().partitionId() << 33
        for batch in batches:
            for low, texts in text_slices(batch, 1, _FIT):
                _, _, _, h, owner = cutter.words(texts)
                n = len(texts)
                n_words = np.bincount(owner, minlength=n)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
                # a row of its own for each document, before its words
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row + np.arange(n), row + owner])), pa.concat_arrays([batch.column(0).slice(low, n).cast(pa.int64()), pa.nulls(len(h), pa.int64())]),
                        pa.array(np.concatenate([np.full(n, -1), place])), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(h)]),
                    ],
                    names=["row", "doc_id", "place", "key"],
                )
                row += n

    return released(run)


def encode_documents(docs: DataFrame, path: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, in order, of every document. Every place of a word is joined with
    the encoded words and sorted back to its document, which shuffles the ids; where a
    count or a digest will do, encode_digest() shuffles far less."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, encoded = encoded_vocabulary(own, path, kind, both=False)
    pieces = [r[0] for r in pieces_of(load(path))]
    places = own.mapInArrow(_keyed(pieces), "row long, doc_id long, place long, key long")
    joined = places.join(encoded.select(F.col("key").alias("w_key"), "ids"), F.col("key") == F.col("w_key"), "left")
    parts = F.sort_array(F.collect_list(F.struct("place", "ids")))
    grouped = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), parts.alias("p"))
    return grouped.select("doc_id", F.flatten(F.filter(F.transform("p", lambda x: x["ids"]), lambda x: x.isNotNull())).alias("ids"))
