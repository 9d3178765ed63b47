"""Embedding near-duplicates by product quantisation with coarse inverted lists.

Vectors that are equal component by component form a class, which is indexed once. A
coarse quantiser (``lists`` centroids) and codebooks for the residual in ``parts``
subspaces are fitted on a bounded sample of ``sample`` vectors; every class is
indexed: its list, its residual code, and the length of what the code misses.

Every class is also a query against its ``probes`` nearest lists. In a list the inner
product with each coded vector comes from table look-ups (a query's products with all
codewords, added up by code). A code's error bounds how far that can be off, so a
vector is passed on only if product plus error reaches the threshold, and no link in a
probed list is lost. What passes is ranked by the exact cosine in double precision.
A pair is found if either side probes the other's list, and counted once for each
side. Cells return counts and a forest of links, never the pairs of a group. Large
lists are dealt to cells of bounded size by hash, so a third of all vectors in one
place means more cells, not larger ones.

Vectors of each length have an index of their own, as those of two lengths have no
cosine. Vectors that are null, zero, or hold null or non-finite components link with
nothing, as do rows without an id; their component is their own id. Repeated rows are
equal vectors. A cosine at the threshold links. An empty table gives an empty result.
Further columns, whatever their names, are not read.

The lists grow with the root of the number of vectors (up to MAX_LISTS), the probes with
the root of the lists, 24 at least, so that the share of a vector's neighbours that is
found holds; tests measure it against brute force.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

MAX_LISTS = 16384
_MEMBERS, _QUERIES = 1024, 1024


@dataclass
class Index:
    coarse: np.ndarray  # lists x dim
    books: np.ndarray  # parts x codes x width, dim padded to parts * width


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        full = n > 0
        centres[full] = total[full] / n[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(k, len(centres))), dtype=np.int32)
    half = (centres * centres).sum(axis=1) / 2
    for at in range(0, len(x), 2048):
        score = half[None] - x[at : at + 2048] @ centres.T
        if out.shape[1] == 1:
            out[at : at + 2048, 0] = score.argmin(axis=1)
            continue
        some = np.argpartition(score, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(centres) else np.tile(np.arange(len(centres)), (len(score), 1))
        order = np.argsort(np.take_along_axis(score, some, axis=1), axis=1, kind="stable")
        out[at : at + 2048] = np.take_along_axis(some, order, axis=1)
    return out


def padded(x: np.ndarray, parts: int) -> np.ndarray:
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1])))


def fit(sample: np.ndarray, lists: int, parts: int, codes: int, seed: int = 5) -> Index:
    coarse = kmeans(sample, min(lists, len(sample)), 8, seed)
    rest = padded(sample - coarse[nearest(sample, coarse, 1)[:, 0]], parts)
    width = rest.shape[1] // parts
    books = np.zeros((parts, codes, width), dtype=np.float32)
    for p in range(parts):
        got = kmeans(rest[:, p * width : (p + 1) * width], codes, 6, seed + p)
        books[p, : len(got)] = got
        books[p, len(got) :] = got[0]
    return Index(coarse, books)


def encode(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, code, error) of unit vectors."""
    own = nearest(x, index.coarse, 1)[:, 0]
    parts, _, width = index.books.shape
    rest = padded(x - index.coarse[own], parts)
    code = np.stack([nearest(rest[:, p * width : (p + 1) * width], index.books[p], 1)[:, 0] for p in range(parts)], axis=1).astype(np.uint8)
    coded = np.concatenate([index.books[p][code[:, p]] for p in range(parts)], axis=1)
    return own, code, np.sqrt(((rest - coded).astype(np.float64) ** 2).sum(axis=1))


def approximate(q: np.ndarray, centre: np.ndarray, code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products of queries with coded vectors of one list, by table look-up."""
    parts, _, width = books.shape
    wide = padded(q, parts)
    out = np.repeat((q @ centre)[:, None], len(code), axis=1)
    for p in range(parts):
        tables = wide[:, p * width : (p + 1) * width] @ books[p].T
        out += tables[:, code[:, p]]
    return out


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column.to_pylist()]) if len(column) else np.zeros((0, dim))
    scale = np.abs(x).max(axis=1, keepdims=True) if len(x) else np.ones((0, 1))
    y = x / np.where(scale > 0, scale, 1)
    return x, y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)


def _indexed(shared, dim: int, probes: int):
    schema = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("unit", pa.binary()), ("list", pa.int32()), ("code", pa.binary()), ("error", pa.float64()), ("probes", pa.list_(pa.int32()))])

    def run(batches):
        index = shared.value
        for batch in batches:
            _, unit = _units(batch.column(2), dim)
            if not len(unit):
                continue
            small = unit.astype(np.float32)
            own, code, error = encode(small, index)
            near = nearest(small, index.coarse, probes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(near.tolist(), pa.list_(pa.int32()))],
                schema=schema,
            )

    return run


def _cell(shared, dim: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        index = shared.value
        number = table.column("list")[0].as_py()
        is_query = table.column("is_query").to_numpy()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        units = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float64).reshape(-1, dim)
        qs, ms = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out_a, out_n, edges = [], [], []
        if len(qs) and len(ms):
            code = np.frombuffer(b"".join(table.column("code").take(pa.array(ms)).to_pylist()), dtype=np.uint8).reshape(len(ms), -1)
            error = table.column("error").to_numpy()[ms]
            probes = table.column("probes").to_pylist()
            own = table.column("own").to_numpy()
            count = np.zeros(len(rep), dtype=np.int64)
            parent: dict[int, int] = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            probed = [set(probes[m]) for m in ms]
            for at in range(0, len(qs), 256):
                q = qs[at : at + 256]
                near = approximate(units[q].astype(np.float32), index.coarse[number], code, index.books) + error[None] >= least - 1e-5
                i, j = np.nonzero(near)
                for low in range(0, len(i), 200_000):
                    a, b = q[i[low : low + 200_000]], ms[j[low : low + 200_000]]
                    jj = j[low : low + 200_000]
                    cosine = np.einsum("ij,ij->i", units[a], units[b])
                    hit = (cosine >= least) & (rep[a] != rep[b])
                    a, b, jj = a[hit], b[hit], jj[hit]
                    np.add.at(count, a, copies[b])
                    # the other side counts it here only if it does not probe this query's list
                    for x, y, k in zip(a.tolist(), b.tolist(), jj.tolist(), strict=True):
                        if own[x] != number and own[x] not in probed[k]:
                            count[y] += copies[x]
                        s, t = root(int(rep[x])), root(int(rep[y]))
                        if s != t:
                            parent[max(s, t)] = min(s, t)
                            edges.append((int(rep[x]), int(rep[y])))
            for k in np.flatnonzero(count):
                out_a.append(int(rep[k]))
                out_n.append(int(count[k]))
        a = out_a + [x for x, _ in edges]
        b = [None] * len(out_a) + [y for _, y in edges]
        n = out_n + [0] * len(edges)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def _linked(classes: DataFrame, dim: int, least: float, probes: int | None, parts: int, codes: int, sample: int, lists: int | None) -> DataFrame:
    """(k1, k2, n_links, component_id) of the classes (k1, k2, rep, copies, v) of one length."""
    spark = classes.sparkSession
    n = classes.count()
    share = min(1.0, 1.2 * sample / n)
    some = classes.filter(F.pmod(F.xxhash64("k2"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("v").limit(sample).toArrow().column(0)
    lists = lists or int(min(MAX_LISTS, max(1, np.sqrt(n))))
    probes = probes or max(24, int(np.ceil(2 * np.sqrt(lists))))
    index = fit(_units(some, dim)[1].astype(np.float32), lists, parts, codes) if len(some) else fit(np.ones((1, dim), dtype=np.float32), 1, parts, codes)
    shared = spark.sparkContext.broadcast(index)
    coded = stored(classes.select("rep", "copies", "v").repartition(max(8, -(-n // 5000))).mapInArrow(_indexed(shared, dim, probes), "rep long, copies long, unit binary, list int, code binary, error double, probes array<int>"), "coded")
    # cells: at most MAX_LISTS rows tell how many blocks each list has of members and queries
    asked = coded.select("rep", F.explode("probes").alias("list"))
    grid = coded.groupBy("list").agg(F.ceil(F.count("*") / _MEMBERS).cast("int").alias("mb"))
    grid = grid.join(asked.groupBy("list").agg(F.ceil(F.count("*") / _QUERIES).cast("int").alias("qb")), "list")
    grid = F.broadcast(grid.limit(MAX_LISTS))
    members = coded.join(grid, "list").withColumn("m", F.pmod(F.xxhash64("rep"), F.col("mb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    members = members.select("list", "m", "q", F.lit(False).alias("is_query"), "rep", "copies", "unit", "code", "error", "probes", F.col("list").alias("own"))
    queries = coded.withColumn("own", F.col("list")).drop("list").withColumn("list", F.explode("probes")).join(grid, "list")
    queries = queries.withColumn("q", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("qb")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    queries = queries.select("list", "m", "q", F.lit(True).alias("is_query"), "rep", "copies", "unit", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("error"), F.lit(None).cast("array<int>").alias("probes"), "own")
    found = stored(members.unionByName(queries).groupBy("list", "m", "q").applyInArrow(_cell(shared, dim, least), "a long, b long, n long"), "found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(found.filter("b is not null").select("a", "b"))
    known = classes.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(comps, F.col("rep") == comps["node"], "left")
    return stored(known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")


def near_duplicates(vectors: DataFrame, least: float = 0.9, probes: int | None = None, parts: int = 16, codes: int = 256, sample: int = 16384, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(finite & F.col("vec_id").isNotNull(), F.lit(False)))
    keys = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.col("v")).alias("k2")]
    classes = stored(rows.filter("fine").select("vec_id", "v", *keys).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    known = None
    for dim in sorted(r[0] for r in classes.select(F.size("v").alias("dim")).distinct().collect()):
        found = _linked(classes.filter(F.size("v") == dim), dim, least, probes, parts, codes, sample, lists)
        known = found if known is None else known.unionByName(found)
    if known is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    own = rows.select("vec_id", F.when(F.col("fine"), keys[0]).alias("k1"), F.when(F.col("fine"), keys[1]).alias("k2"))
    out = own.join(known, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
