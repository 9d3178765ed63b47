"""N-gram Jaccard join by multiple-global-order filtering, exact.

A document's set is that of its 3-word shingles (hashed to 64 bits); two documents
link when their sets' Jaccard similarity is at least ``percent`` / 100.

Documents with equal sets form a class, which takes part once. If a set x links to
any other, they share one of the first ``n - ceil(t n) + 1`` shingles of x under any
total order. Three orders put rare shingles first, by the levels (powers of the root of
two) of a sketch of the counts over all documents, and shingles of one level by a hash of
the order's own. The classes that share a prefix token of order A are candidates; a pair must share
one under B and C as well. Then the eighth part of both sets whose hashes end in three
zero bits (kept as 32 bits each) bounds their intersection, and only pairs that can still link fetch the sets.

Only components are asked for, so not all pairs of a token are made. In rounds, every
class is compared with one hub of each of its tokens, another one each round; links
found so merge components, and tokens whose classes all lie in one component need
nothing more. A group of near copies, however large, is settled so without its pairs.
Rounds end when they no longer settle half of what is left. Of the tokens left,
those with at most ``few`` classes give their pairs. The classes of the others are
gathered to clusters and dealt to cells of two blocks, of classes whose sizes fit. A
cell first intersects the filters of the three orders for its pairs, as products of
matrices; only classes left with a candidate send their sets there, whose intersections
are counted likewise, and a forest of the links comes back. So no pairs are emitted there, each pair of a cluster is compared
once, and no pair that could join two components is left out: the components are exact.

Null text and text without words: the set is empty, the size 0, no link. A null id
takes part; the component of a class without any id is null. Repeated rows are
members of their class. Links at exactly the threshold count. A very long text needs
memory in proportion to itself. An empty table gives an empty result. Further columns,
whatever their names, are not read (keep_one() returns them; names that begin with __tl_
are reserved). Two different sets count as equal, or two shingles or words as one, only
if 64-bit hashes collide.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, forget, in_bitmap, released, scratch, stored, text_slices, trim
from .graph import components

_MULT = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_FINAL = np.uint64(0xD6E8FEB86659FD93)
_ORDERS = [np.uint64(0x9FB21C651E98DF25), np.uint64(0x94D049BB133111EB), np.uint64(0xBF58476D1CE4E5B9)]
_SLOT = np.uint64(0xA0761D6478BD642F)
#: Words are hashed as polynomials of their bytes' values, modulo 2^64.
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _UNBASE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FINAL
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: Powers for slices of texts of ordinary size; longer ones are made when needed.
_FIT = 1 << 18
_UP, _DOWN = _powers(_BASE, _FIT), _powers(_UNBASE, _FIT)


def _unique(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is faster here than np.unique's hashing."""
    x = np.sort(x)
    new = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles, words cut at the six ASCII
    spaces and A-Z lower-cased; all texts' bytes, words and shingles at once."""
    raws = [(t or "").encode() for t in texts]
    flat = _LOWER[np.frombuffer(b" ".join([b"", *raws, b""]), dtype=np.uint8)]
    word = ~_SPACE[flat]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    # sums of the bytes' values times powers by place, as they wrap around
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    up, down = (_UP, _DOWN) if len(flat) <= _FIT else (_powers(_BASE, len(flat)), _powers(_UNBASE, len(flat)))
    np.cumsum(_BYTES[flat] * up[: len(flat)], out=total[1:])
    h = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _MULT[1])
    ends = np.cumsum([len(r) + 1 for r in raws])
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    n = max(0, len(h) - width + 1)
    every = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        every = _mix(every * _MULT[k % 3] + h[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(_unique(every[a : b - width + 1]))
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                x = _mix(x * _MULT[0] + h[k])
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def slot(found: np.ndarray, bits: int) -> np.ndarray:
    """The place of each shingle in the sketch."""
    return ((found * _SLOT) >> np.uint64(64 - bits)).astype(np.int64)


def prefixes(found: np.ndarray, orders: tuple[int, ...], bits: int, levels: np.ndarray, percent: int) -> list[np.ndarray]:
    """The first shingles of a set under each order: low levels first, then by hash."""
    p = prefix_size(len(found), percent)
    level = levels[slot(found, bits)].astype(np.uint64) << np.uint64(56)
    return [found[np.argpartition(level | ((found * _ORDERS[k]) >> np.uint64(8)), p - 1)[:p]] for k in orders]


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


_STEP = 4096
_SIZED = "doc_id long, n int, cls long, sk_from int, sk binary"


def _sized(width: int, bits: int):
    """Per document size and class; at the end of a partition its sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("sk_from", pa.int32()), ("sk", pa.binary())])

    def run(batches):
        sketch = np.zeros(1 << bits, dtype=np.uint32)
        with np.errstate(over="ignore"):
            for batch in batches:
                for low, texts in text_slices(batch, 1, _FIT >> 1):
                    n = len(texts)
                    seen = shingle_sets(texts, width)
                    sizes, classes = [len(s) for s in seen], [class_of(s) if len(s) else None for s in seen]
                    np.add.at(sketch, slot(np.concatenate(seen), bits), 1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n).cast(pa.int64()), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        for low in range(0, len(sketch), 64 * _STEP):
            rows = [(k, np.minimum(sketch[k : k + _STEP], 65535).astype("<u2").tobytes()) for k in range(low, min(low + 64 * _STEP, len(sketch)), _STEP) if sketch[k : k + _STEP].any()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

    return released(run)


def _levels(batches):
    """Sketch rows sorted by place, added up and brought to levels of one byte."""

    def done():
        level = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["sk_from", "levels"])

    now, total = None, None
    for batch in batches:
        for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(raw.as_buffer(), dtype="<u2")
            if at != now:
                if now is not None:
                    yield done()
                now, total = at, np.zeros(len(part), dtype=np.int64)
            total += part
    if now is not None:
        yield done()


def _new_sets(batches, width: int):
    """Lists of (class, set) of the texts whose class this partition has not met before
    (as far as a bounded memory tells: a class may come again)."""
    seen: set[int] = set()
    with np.errstate(over="ignore"):
        for batch in batches:
            for _, texts in text_slices(batch, 0, _FIT >> 1):
                if len(seen) > 200_000:
                    seen.clear()
                fresh = []
                for s in shingle_sets(texts, width):
                    c = class_of(s) if len(s) else None
                    if c is not None and c not in seen:
                        seen.add(c)
                        fresh.append((c, s))
                if fresh:
                    yield fresh


def _postings(width: int, percent: int, bits: int, shared):
    """(token, cls, n) of the prefix under order A of each class, once a partition."""

    def run(batches):
        for fresh in _new_sets(batches, width):
            tokens = [prefixes(s, (0,), bits, shared.value, percent)[0] for _, s in fresh]
            many = [len(t) for t in tokens]
            columns = np.concatenate(tokens).view(np.int64), np.repeat(np.array([c for c, _ in fresh], dtype=np.int64), many), np.repeat(np.array([len(s) for _, s in fresh], dtype=np.int32), many)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "cls", "n"])

    return released(run)


_FEATURES = "cls long, n int, pb array<int>, pc array<int>, part array<int>, items array<long>"


def _features(width: int, percent: int, bits: int, shared):
    """(cls, n, prefixes under B and C, the eighth part, the set) of each document."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int32()), ("pb", pa.list_(pa.int32())), ("pc", pa.list_(pa.int32())), ("part", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for fresh in _new_sets(batches, width):
            for low in range(0, len(fresh), 500):
                out: list[list] = [[] for _ in schema]
                for c, s in fresh[low : low + 500]:
                    # 32 bits of a token are enough to ask whether none is shared, and how
                    # many at most (equal ones stay in the list, so none is undercounted)
                    eighth = s[s & np.uint64(7) == 0]
                    short = [(x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in (*prefixes(s, (1, 2), bits, shared.value, percent), eighth)]
                    for column, value in zip(out, [c, len(s), *short, s.view(np.int64)], strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return released(run)


def _only(docs: DataFrame, key: str, keys: DataFrame, bits: int = 23) -> DataFrame:
    """Rows whose key's hash is in a bitmap of fixed size: all whose key is in keys, and
    some others, which the later join on the key leaves out."""
    return in_bitmap(docs, key, keys, bits).filter("__tl_near").select(docs.columns)


def _verified(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Those of stored distinct pairs (a, b) that link, stored: by orders B and C, the bound
    of the eighth parts, then the sets."""

    def sides(pairs, columns):
        named = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
        own = _only(features.select("cls", "n", *columns), "cls", named)
        left, right = (own.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *columns))) for x in ("a", "b"))
        return pairs.join(left, "a").join(right, "b")

    both = sides(pairs, ("pb", "pc", "part"))
    # equal 32 bits within a part are one value to array_intersect: what it lacks is added
    twice = lambda x: F.size(f"part_{x}") - F.size(F.array_distinct(f"part_{x}"))
    most = F.size(F.array_intersect("part_a", "part_b")) + F.least(twice("a"), twice("b")) + F.least(F.col("n_a") - F.size("part_a"), F.col("n_b") - F.size("part_b"))
    can = F.arrays_overlap("pb_a", "pb_b") & F.arrays_overlap("pc_a", "pc_b") & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    left = stored(both.filter(can).select("a", "b").distinct(), "possible")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    linked = 100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)
    out = stored(sides(left, ("items",)).filter(linked).select("a", "b").distinct(), "links")
    drop_stored(left)
    return out


def _fits(x, y, percent: int):
    return (100 * F.least(x, y)) >= (percent * F.greatest(x, y))


def _shared_postings(made: DataFrame, percent: int) -> DataFrame:
    """The postings that have another class of a fitting size at the same token. Sizes
    that fit lie in the same or the next step of a scale by percent / 100, so a look at
    three steps drops no pair."""
    token = Window.partitionBy("token")
    several = made.withColumn("lo", F.min("cls").over(token)).withColumn("hi", F.max("cls").over(token)).filter("lo != hi")
    several = stored(several.select("token", "cls", "n", _step(percent).alias("step")).distinct(), "several")
    spans = several.groupBy("token", "step").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    spans = spans.select("token", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), "lo", "hi")
    fitting = spans.groupBy("token", "step").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("token", "step")
    return several.join(fitting, ["token", "step"]).select("token", "cls", "n")


#: Classes and shingles of a block of a cluster.
_BLOCK, _BLOCK_ITEMS = 1024, 300_000


def _product(lists: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many values each two of the lists share (each holds a value once), as a matrix
    product in slices of the values that are in more than one list."""
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists) if len(lists) else np.zeros(0, dtype=np.int64)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, column = np.repeat(np.arange(len(lists)), sizes)[keep], column[place][keep]
    # values of the same lists stand together, so a slice of them meets few lists
    edges = int(shared.sum())
    first, last = np.full(edges, len(lists)), np.zeros(edges, dtype=np.int64)
    np.minimum.at(first, column, owner)
    np.maximum.at(last, column, owner)
    rank = np.empty(edges, dtype=np.int64)
    rank[np.lexsort((last, first))] = np.arange(edges)
    column = rank[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(lists), len(lists)), dtype=np.float32)
    for low in range(0, edges, width):
        x, y = np.searchsorted(column, [low, low + width])
        rows, own = np.unique(owner[x:y], return_inverse=True)
        part = np.zeros((len(rows), min(width, edges - low)), dtype=np.float32)
        part[own, column[x:y] - low] = 1
        common[np.ix_(rows, rows)] += part @ part.T
    return common


def _filtered(table: pa.Table) -> pa.Table:
    """Those rows (cluster, i, j, cls, comp, pa, pb, pc) of a cell that share a token with
    another one, of another component, under each of the three orders."""
    comps = table.column("comp").to_numpy()
    can = comps[:, None] != comps[None, :]
    for order in ("pa", "pb", "pc"):
        can &= _product([np.unique(x.values.to_numpy()) for x in table.column(order)]) > 0
    trim()
    return table.filter(pa.array(can.any(axis=1))).select(["cluster", "i", "j", "cls", "comp"])


def _links(percent: int):
    """Links within a cell, as a forest: rows (cls, comp, items) of two blocks."""

    def run(table: pa.Table) -> pa.Table:
        classes, comps = table.column("cls").to_numpy(), table.column("comp").to_numpy()
        sets = [x.values.to_numpy() for x in table.column("items")]
        sizes = np.array([len(x) for x in sets])
        common = _product(sets)
        linked = (comps[:, None] != comps[None, :]) & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
        parent = list(range(len(sets)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
            x, y = root(int(i)), root(int(j))
            if x != y:
                parent[y] = x
                out.append((int(classes[i]), int(classes[j])))
        trim()
        return pa.table([pa.array([max(x) for x in out], pa.int64()), pa.array([min(x) for x in out], pa.int64())], names=["a", "b"])

    return run


def _cluster_links(crowded: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Links between the classes that share a crowded token, by cells of two blocks. A
    block holds classes of one step of size (a link's sizes lie in the same or the next
    step), so a cluster that chains sizes together is not compared across them."""
    hubs = crowded.groupBy("token").agg(F.min("cls").alias("hub"))
    clusters = components(crowded.join(hubs, "token").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    tokens = crowded.groupBy("cls", "comp", "n").agg(F.collect_set("token").alias("pa"))
    members = clusters.join(tokens, clusters["node"] == tokens["cls"]).select("cls", F.col("component").alias("cluster"), "comp", "n", "pa", _step(percent).alias("step"))
    sizes = members.groupBy("cluster", "step").agg(F.greatest(F.ceil(F.count("*") / _BLOCK), F.ceil(F.sum("n") / _BLOCK_ITEMS)).cast("int").alias("blocks"))
    members = members.join(sizes, ["cluster", "step"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    above = sizes.select("cluster", (F.col("step") - 1).alias("step"), F.col("blocks").alias("blocks_above"))
    below = sizes.select("cluster", (F.col("step") + 1).alias("step"), F.col("blocks").alias("blocks_below"))
    members = members.join(above, ["cluster", "step"], "left").join(below, ["cluster", "step"], "left")
    block = lambda step, k: F.struct(step.cast("int").alias("step"), k.alias("k"))
    numbers = lambda name: F.when(F.col(name).isNotNull(), F.sequence(F.lit(0), F.col(name) - 1)).otherwise(F.array().cast("array<int>"))
    others = F.concat(*(F.transform(numbers(name), lambda k, d=d: block(F.col("step") + d, k)) for name, d in (("blocks", 0), ("blocks_above", 1), ("blocks_below", -1))))
    here = block(F.col("step"), F.col("own"))
    cells = members.withColumn("other", F.explode(others)).select("cluster", F.least(here, F.col("other")).alias("i"), F.greatest(here, F.col("other")).alias("j"), "cls", "comp", "pa")
    near = stored(_only(features, "cls", crowded.select("cls")).dropDuplicates(["cls"]), "members")
    cells = cells.join(near.select("cls", "pb", "pc"), "cls").select("cluster", "i", "j", "cls", "comp", "pa", "pb", "pc")
    place = "struct<step:int,k:int>"
    left = stored(cells.groupBy("cluster", "i", "j").applyInArrow(_filtered, f"cluster long, i {place}, j {place}, cls long, comp long"), "cells")
    rows = left.join(near.select("cls", "items"), "cls").select("cluster", "i", "j", "cls", "comp", "items")
    return rows.groupBy("cluster", "i", "j").applyInArrow(_links(percent), "a long, b long").distinct()


def _step(percent: int):
    """Sizes of sets that can link lie in the same or the next step."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100) + 1e-9)).cast("int") if percent < 100 else F.col("n")


def class_links(postings: DataFrame, features: DataFrame, percent: int, few: int = 24, shrink: float = 0.5) -> DataFrame:
    """Links that span the components of the classes; the stored postings are deleted."""
    open_, left = postings.withColumn("comp", F.col("cls")), None
    links = tried = None
    for number in itertools.count():
        salted = F.xxhash64("cls", F.lit(number)) if number else F.col("cls")
        hubs = open_.groupBy("token").agg(F.min_by(F.struct("cls", "n", "comp"), salted).alias("hub"))
        pairs = open_.join(hubs, "token").filter((F.col("hub.comp") != F.col("comp")) & _fits(F.col("n"), F.col("hub.n"), percent))
        pairs = pairs.select(F.greatest("cls", "hub.cls").alias("a"), F.least("cls", "hub.cls").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _verified(pairs, features, percent)
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        labelled = open_.select("token", "cls", "n").join(labels, F.col("cls") == labels["node"], "left").select("token", "cls", "n", F.coalesce("component", "cls").alias("comp"))
        split = labelled.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo != hi")
        last, open_ = open_, stored(labelled.join(split.select("token", "size"), "token"), "open")
        drop_stored(last)
        before, left = left, open_.filter(F.col("size") > few).count()
        forget(postings.sparkSession)
        if not left or before is not None and left > shrink * before:
            break
    rest = open_.filter(F.col("size") <= few)
    a = rest.select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    b = rest.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = a.join(b, "token").filter((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & _fits(F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(_verified(pairs, features, percent))
    if left:
        links = links.unionByName(stored(_cluster_links(open_.filter(F.col("size") > few), features, percent), "links"))
    return links


def join(docs: DataFrame, percent: int = 90, width: int = 3, sketch_bits: int = 22, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sized = stored(own.mapInArrow(_sized(width, sketch_bits), _SIZED), "sized")
    parts = sized.filter("sk_from is not null").select("sk_from", "sk").repartition("sk_from").sortWithinPartitions("sk_from")
    levels = np.zeros(1 << sketch_bits, dtype=np.uint8)
    for at, raw in zip(*(c.to_pylist() for c in parts.mapInArrow(_levels, "sk_from int, levels binary").toArrow().columns), strict=True):
        levels[at : at + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    rows = sized.filter("sk_from is null").select("doc_id", "n", "cls")
    shared = spark.sparkContext.broadcast(levels)
    with scratch(spark) as keep:
        made = own.select("text").mapInArrow(_postings(width, percent, sketch_bits, shared), "token long, cls long, n int")
        postings = stored(_shared_postings(made, percent), "postings")
        reps = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
        needed = reps.join(postings.select("cls").distinct(), "cls", "left_semi").select("doc_id")
        near = _only(own.withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long"))), "id", needed.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("id")))
        features = stored(near.select("text").mapInArrow(_features(width, percent, sketch_bits, shared), _FEATURES), "features")
        labels = components(class_links(postings, features, percent))
        named = reps.join(labels, reps["cls"] == labels["node"], "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("component"))
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        of_class = keep(stored(named.join(least, "component").select(F.col("cls").alias("of_cls"), "component_id"), "classes"))
    out = rows.join(of_class, rows["cls"] == of_class["of_cls"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group of near-duplicates: the one of
    the smallest id. A row without an id goes by a hash of its text; of rows with one id
    one stays. Documents without words are in no group and stay."""
    own = docs.withColumn("__tl_key", F.coalesce(F.col(id_col).cast("long"), F.least(F.xxhash64(F.col(text_col)), F.lit(0).cast("long"))))
    with scratch(docs.sparkSession) as keep:
        grouped = stored(join(own.select("__tl_key", text_col), percent, width, id_col="__tl_key", text_col=text_col), "groups")
        gone = grouped.filter("component_id != doc_id").select(F.col("doc_id").alias("__tl_key")).distinct()
        again = grouped.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__tl_key"))
        # only the few rows whose key may be among these are shuffled
        special = keep(stored(gone.withColumn("__tl_gone", F.lit(True)).unionByName(again.withColumn("__tl_gone", F.lit(False))), "gone"))
    marked = in_bitmap(own, "__tl_key", special.select("__tl_key"))
    sure = marked.filter(~F.col("__tl_near")).select(docs.columns)
    # an outer join: an anti join would be moved below the bitmap's, to all rows
    flags = special.groupBy("__tl_key").agg(F.max("__tl_gone").alias("__tl_out"))
    near = marked.filter("__tl_near").select("__tl_key", *docs.columns).join(flags, "__tl_key", "left").filter("__tl_out is null or not __tl_out")
    single = near.filter("__tl_out is null").select(docs.columns)
    several = near.filter("__tl_out is not null").dropDuplicates(["__tl_key"]).select(docs.columns)
    return sure.unionByName(single).unionByName(several)
