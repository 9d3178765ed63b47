"""Best-fit packing by a grouping genetic algorithm on islands.

``tokenized_pieces`` cuts every document into pieces of at most ``capacity``
tokens; ``pack`` puts the pieces into as few sequences as it can.

Items are dealt to shards of about ``island_items`` by their item id, so no key of the
data can make a shard large. Each shard is packed by ``copies`` islands, tasks of their
own with seeds of their own, whose populations of packings evolve: a crossover injects
whole well-filled bins of one parent into the other, removes the bins that hold the same
items, and puts the displaced items back by best fit. After each epoch the elite, each
island's best packing, migrates to the next island of the shard's ring, and replaces its
worst; after the last the best packing of the shard's islands counts. Every island makes
at least ``generations`` / 2 crossovers an epoch, and goes on to ``generations`` while it
stands above the lower bound.

Between levels the bins filled to ``elite_fill`` at least stay, and all others are opened
and dealt to fewer shards, as many as their items fill. When opening bins no longer
leaves fewer shards, as with items that no second one fits beside, all bins stay. So a
shard never holds more than about ``island_items`` items.

Null, empty and very long texts: a null text counts as empty (one token, the end
token), a long one is cut only where it exceeds the capacity. Repeated rows are
separate items, as are rows without an id; equal sizes go by item id. An empty table
gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import math
import os
import random
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, forget, hashes, released, stored, text_slices

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters that str.split() takes for space and the tokenizer's \s does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Beyond these, lower-casing and composing a text may not be done word by word.
_LATIN = 0x250


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the code points below _LATIN: the lower-case letter, whether it is one of those
    that an odd word holds, and whether a stop or comma after it is a token of its own."""
    lower = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(_LATIN)], dtype=np.uint32)
    odd = np.zeros(_LATIN + 1, dtype=bool)
    odd[[0x130, _LATIN]] = True
    plain = np.zeros(_LATIN + 1, dtype=bool)
    for low, high in (("a", "z"), ("0", "9"), ("ß", "ö"), ("ø", "ɏ")):
        plain[ord(low) : ord(high) + 1] = True
    return lower, odd, plain


_LOWER, _ODD, _PLAIN = _tables()
_SPACE = np.zeros(0x3001, dtype=bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
class Memo:
    """Ids of words by hash, in arrays: a large and a small sorted level, the small one
    merged into the large when it has grown. Cleared beyond ``most`` bytes."""

    def __init__(self, most: int = 24 << 20, small: int = 30_000):
        self.most, self.small = most, small
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.levels = [(none, none, none), (none, none, none)]  # hash, start, number of ids
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def size(self) -> int:
        return self.flat.nbytes + 24 * sum(len(x[0]) for x in self.levels)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of ids) of each key; -1 if it is not known."""
        start, many = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for own, s, n in self.levels:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                start[hit], many[hit] = s[at[hit]], n[at[hit]]
        return start, many

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of ids) of keys that were not known."""
        many = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        start = self.used + np.cumsum(many) - many
        end = self.used + int(many.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(end, 2 * len(self.flat)) - self.used, dtype=np.uint32)])
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=end - self.used)
        self.used = end
        self.levels[1] = self._merged(self.levels[1], (keys, start, many))
        if len(self.levels[1][0]) > self.small:
            self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]
        return start, many

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True))


_memo = Memo()
_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _memo.clear()
        _loaded.clear()
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def forget_tokenizer() -> None:
    _memo.clear()
    _loaded.clear()


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _words(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts as one, each word's start, end, hash and text): the words between white
    space, in Latin letters lower-cased (as the tokenizer does) and with a final stop or
    comma apart (which it does, too), so there are fewer different ones. Words of other
    letters stay as they are."""
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = _SPACE[np.minimum(code, 0x3000)] & (code <= 0x3000)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    start, end = edge[0::2], edge[1::2]
    near = np.minimum(code, _LATIN)
    strange = np.concatenate([[0], np.cumsum(_ODD[near])])
    odd = strange[end] > strange[start]
    lower = np.where(code < _LATIN, _LOWER[np.minimum(near, _LATIN - 1)], code)
    if odd.any():
        for a, b in zip(start[odd].tolist(), end[odd].tolist(), strict=True):
            lower[a:b] = code[a:b]
    last = lower[end - 1]
    apart = ~odd & (end - start > 1) & ((last == 46) | (last == 44)) & _PLAIN[np.minimum(lower[end - 2], _LATIN)]
    order = np.argsort(np.concatenate([start, end[apart] - 1]), kind="stable")
    start, end = np.concatenate([start, end[apart] - 1])[order], np.concatenate([np.where(apart, end - 1, end), end[apart]])[order]
    sizes = np.cumsum([len(t) + 1 for t in texts])
    return lower.tobytes().decode("utf-32-le", "surrogatepass"), start, end, hashes(lower, start, end), np.searchsorted(sizes, start, side="right")


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text. The tokenizer drops white space and
    never merges over it, so ids are looked up by the (64-bit hashes of) words between
    white space; words not yet known are encoded together and kept, up to a bound."""
    tok = _tokenizer(path)
    if _memo.size() > _memo.most:
        _memo.clear()
    alone = [bool(_ODD_SPACE.search(t)) for t in texts]
    whole, start, end, key, owner = _words(["" if x else t for t, x in zip(texts, alone, strict=True)])
    keys, first, which = distinct(key)
    at, sizes = _memo.find(keys)
    new = np.flatnonzero(at < 0)
    for low in range(0, len(new), 4_000):
        part = new[low : low + 4_000]
        words = [whole[a:b] for a, b in zip(start[first[part]].tolist(), end[first[part]].tolist(), strict=True)]
        at[part], sizes[part] = _memo.add(keys[part], [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)])
    many = sizes[which]
    ends = np.cumsum(many)
    ids = _memo.flat[np.repeat(at[which] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)]
    cuts = np.concatenate([[0], ends])[np.searchsorted(owner, np.arange(len(texts) + 1))] * 4
    raw = ids.tobytes()
    out = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return [_as_bytes(tok.encode(t, add_special_tokens=False).ids) if x else made for t, x, made in zip(texts, alone, out, strict=True)]


def _pieces(tokenizer_path: str, capacity: int, end_id: int):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, 1, 1 << 18):
                own = batch.column(0).slice(at, len(texts)).to_pylist()
                some = [t or "" for t in texts]
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, raw in zip(own, token_bytes(some, tokenizer_path), strict=True):
                    raw += end
                    for k, start in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[start : start + 4 * capacity]
                        for column, value in zip(out, (doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, type=t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return released(run, None, forget_tokenizer)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document, with an item id of its own."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pieces(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    return found.select(F.monotonically_increasing_id().alias("item"), "*")


class Bins:
    """Packing of items (by index) into bins, with best-fit insertion. ``free`` holds
    (free room, bin) sorted, so the tightest bin that fits is found by bisection."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.room: dict[int, int] = {}
        self.home: dict[int, int] = {}
        self.free: list[tuple[int, int]] = []
        self.next = 0

    def copy(self) -> Bins:
        other = Bins(self.sizes, self.capacity)
        other.bins = {k: list(v) for k, v in self.bins.items()}
        other.room, other.home, other.free, other.next = dict(self.room), dict(self.home), list(self.free), self.next
        return other

    def add_bin(self, items: list[int]) -> None:
        k, self.next = self.next, self.next + 1
        self.bins[k] = items
        self.room[k] = self.capacity - sum(self.sizes[i] for i in items)
        for i in items:
            self.home[i] = k
        if self.room[k]:
            bisect.insort(self.free, (self.room[k], k))

    def drop_bin(self, k: int) -> list[int]:
        if self.room[k]:
            del self.free[bisect.bisect_left(self.free, (self.room[k], k))]
        del self.room[k]
        items = self.bins.pop(k)
        for i in items:
            del self.home[i]
        return items

    def best_fit(self, items: list[int]) -> None:
        for i in items:
            at = bisect.bisect_left(self.free, (self.sizes[i], -1))
            if at == len(self.free):
                self.add_bin([i])
                continue
            room, k = self.free.pop(at)
            self.bins[k].append(i)
            self.home[i] = k
            self.room[k] = room - self.sizes[i]
            if self.room[k]:
                bisect.insort(self.free, (self.room[k], k))

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the mean square of the fill."""
        cap = self.capacity
        return (-len(self.bins), sum((1 - r / cap) ** 2 for r in self.room.values()))


def crossover(mother: Bins, father: Bins, rng: random.Random, share: float) -> Bins:
    """Whole well-filled bins of the father go into a copy of the mother."""
    child = mother.copy()
    good = sorted(father.room, key=lambda k: (father.room[k], k))
    good = good[: max(1, len(good) // 2)]
    chosen = rng.sample(good, max(1, min(len(good), round(share * len(good)))))
    displaced: list[int] = []
    taken: set[int] = set()
    for k in chosen:
        taken.update(father.bins[k])
    for k in {child.home[i] for i in taken}:
        displaced += [i for i in child.drop_bin(k) if i not in taken]
    for k in chosen:
        child.add_bin(list(father.bins[k]))
    # the emptiest bins are opened too, or the child could never have fewer bins
    worst = [k for _, k in child.free[-max(2, len(child.bins) // 50) :]]
    for k in worst:
        displaced += child.drop_bin(k)
    displaced.sort(key=lambda i: (-child.sizes[i], i))
    child.best_fit(displaced)
    return child


def first_herd(sizes: list[int], capacity: int, rng: random.Random, population: int) -> list[Bins]:
    """Best fit of the items in decreasing order, strict in one packing, more and more
    loose in the others."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    herd = []
    for k in range(population):
        packing = Bins(sizes, capacity)
        packing.best_fit(sorted(order, key=lambda i, k=k: -sizes[i] * (1 + 0.02 * k * rng.random())) if k else order)
        herd.append(packing)
    return herd


def evolve(herd: list[Bins], seed: int, generations: int) -> list[Bins]:
    """The herd after crossovers, best first: at least half of ``generations``, and no
    more once the best has as few bins as the items' sum allows."""
    rng = random.Random(seed)
    herd = sorted(herd, key=Bins.fitness, reverse=True)
    if len(herd) < 2:
        return herd
    least = math.ceil(sum(herd[0].sizes) / herd[0].capacity)
    for k in range(generations):
        if k >= generations // 2 and len(herd[0].bins) <= least:
            break
        a, b = rng.sample(range(len(herd)), 2)
        child = crossover(herd[a], herd[b], rng, 0.2 + 0.3 * rng.random())
        if child.fitness() > herd[-1].fitness():
            herd[-1] = child
            herd.sort(key=Bins.fitness, reverse=True)
    return herd


def to_genes(packing: Bins) -> bytes:
    """The number of each item's bin."""
    home = np.empty(len(packing.sizes), dtype="<i4")
    for number, items in enumerate(packing.bins.values()):
        home[items] = number
    return home.tobytes()


def from_genes(genes: bytes, sizes: list[int], capacity: int) -> Bins:
    home = np.frombuffer(genes, dtype="<i4")
    order = np.argsort(home, kind="stable")
    packing = Bins(sizes, capacity)
    for items in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(home) else ():
        packing.add_bin(items.tolist())
    return packing


#: An island: its shard's items and sizes, and its herd, best first; from an island of
#: the ring only the elite comes, with no items.
_ISLAND = "shard long, island int, migrant boolean, items binary, sizes binary, genes array<binary>"
_ISLAND_SCHEMA = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("migrant", pa.bool_()), ("items", pa.binary()), ("sizes", pa.binary()), ("genes", pa.list_(pa.binary()))])


def _settle(capacity: int, level: int, population: int, generations: int):
    """The first epoch of an island, from the rows (shard, island, item, length)."""

    def run(table: pa.Table) -> pa.Table:
        shard, island = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
        items, sizes = table.column("item").to_numpy(), table.column("length").to_numpy()
        order = np.argsort(items, kind="stable")
        items, sizes = items[order], sizes[order]
        seed = (shard * 31 + level) * 7 + island
        herd = evolve(first_herd(sizes.tolist(), capacity, random.Random(seed), population), seed, generations)
        return pa.Table.from_pylist([{"shard": shard, "island": island, "migrant": False, "items": items.tobytes(), "sizes": sizes.tobytes(), "genes": [to_genes(x) for x in herd]}], schema=_ISLAND_SCHEMA)

    return run


def _epoch(capacity: int, level: int, number: int, generations: int):
    """A further epoch of an island, from its row and the elite that came."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if not r["migrant"])
        sizes = np.frombuffer(own["sizes"], dtype=np.int64).tolist()
        came = [g for r in rows if r["migrant"] for g in r["genes"]]
        genes = [*own["genes"][: max(1, len(own["genes"]) - len(came))], *came]
        herd = evolve([from_genes(g, sizes, capacity) for g in genes], ((own["shard"] * 31 + level) * 7 + own["island"]) * 5 + number, generations)
        return pa.Table.from_pylist([own | {"genes": [to_genes(x) for x in herd]}], schema=_ISLAND_SCHEMA)

    return run


def _closed(capacity: int, level: int, last: bool, elite_fill: float):
    """The items of a shard by the best packing of its islands; those of bins that are
    opened have no sequence."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["island"])
        items, sizes = (np.frombuffer(rows[0][c], dtype=np.int64).tolist() for c in ("items", "sizes"))
        best = max((from_genes(r["genes"][0], sizes, capacity) for r in rows), key=Bins.fitness)
        out: tuple[list, ...] = ([], [], [], [])
        for k, held in enumerate(best.bins.values()):
            stays = last or sum(sizes[i] for i in held) >= elite_fill * capacity
            offset = 0
            for i in held:
                for column, value in zip(out, (items[i], sizes[i], (level << 58) | (rows[0]["shard"] << 20) | k if stays else None, offset if stays else None), strict=True):
                    column.append(value)
                offset += sizes[i]
        return pa.table([pa.array(x, type=pa.int64()) for x in out], names=["item", "length", "sequence_id", "offset"])

    return run


def pack(
    items: DataFrame, capacity: int = 4096, island_items: int = 6000, copies: int = 2, epochs: int = 2, elite_fill: float = 0.998, population: int = 3, generations: int = 8
) -> DataFrame:
    """(item, sequence_id, offset) for every row of items (item long, length long),
    which must give the same rows each time it is read."""
    full = items.filter(F.col("length") >= capacity)
    parts = [full.select("item", ((F.lit(7).cast("long") * F.lit(1 << 58).cast("long")) + F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = items.filter(F.col("length") < capacity).select("item", F.col("length").cast("long").alias("length"))
    shards = max(1, math.ceil(rest.count() / island_items))
    level, last = 0, shards == 1
    while True:
        dealt = rest.select(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("island"), "item", "length")
        islands = dealt.groupBy("shard", "island").applyInArrow(_settle(capacity, level, population, generations), _ISLAND)
        for number in range(1, epochs):
            islands = stored(islands, "islands")
            elite = islands.select("shard", F.pmod(F.col("island") + 1, F.lit(copies)).cast("int").alias("island"), F.lit(True).alias("migrant"), F.lit(None).cast("binary").alias("items"), F.lit(None).cast("binary").alias("sizes"), F.slice("genes", 1, 1).alias("genes"))
            islands = islands.unionByName(elite).groupBy("shard", "island").applyInArrow(_epoch(capacity, level, number, generations), _ISLAND)
        best = islands.select("shard", "island", "items", "sizes", F.slice("genes", 1, 1).alias("genes"))
        made = stored(best.groupBy("shard").applyInArrow(_closed(capacity, level, last, elite_fill), "item long, length long, sequence_id long, offset long"), f"pack{level}")
        parts.append(made.filter("sequence_id is not null").select("item", "sequence_id", "offset"))
        if last:
            break
        rest = made.filter("sequence_id is null").select("item", "length")
        fewer = max(1, math.ceil(rest.count() / island_items))
        forget(items.sparkSession)
        level += 1
        # the sequence's bits hold seven levels; what is left shrinks with each
        last = fewer == 1 or fewer > 0.9 * shards or level == 6
        shards = fewer
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, **kw) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = stored(tokenized_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    placed = pack(pieces.select("item", "length"), capacity, **kw)
    return pieces.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
