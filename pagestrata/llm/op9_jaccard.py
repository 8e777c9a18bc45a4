"""N-gram Jaccard join: size-banded tiles with bitmap signatures, exact sorted-array intersection behind them.

A document's set holds the hashes of its distinct word shingles. Equal sets are one node. Two sets that
are similar enough share at least one of the smallest ``n - ceil(t n) + 1`` hashes of each, in any
order that is the same for all; the order used puts hashes of very frequent shingles last, so passages
that many documents share make no candidates. Lists that are ``c - 1`` keys longer share at least ``c`` of
them, so nodes of compatible sizes with ``c`` common keys are candidate pairs, and a single passage or shingle
that two texts have by chance makes none; of a key with very many nodes, only neighbours by size, which keep them together. Keys known to be
frequent are split over tasks by node: each part is chained by itself, and the parts' runs of compatible
sizes are chained by a window over them.

Every set has a bitmap of hashed bits, as wide as its size asks for. A bit set in one bitmap only is a
member of one set only, so bit counts bound a pair's overlap from above, and most pairs end there. The
connected components of the rest are families, whose sets are compared in tiles. A light family is one tile. A heavy one
is dealt by size band into blocks of bounded weight, each a tile by itself, and then once more by shifted bands and other
blocks: a group of near copies of any size is connected by these two rounds in linear work. What is left of it is the
comparison of its smaller components with each other and with the largest one: tiles of two blocks of the same or adjacent
bands, none of two blocks of the largest. Inside a tile pairs meet the bit counts again, and what passes is decided by
intersecting their sorted arrays. Pairs already connected are skipped, so a group of
near copies takes about one comparison a member. A tile reports the links that join components, and the
components of all of them are the result. Texts are never dealt out, whatever the size of the table: bitmaps are made
along with nodes, and the sets of families where their rows lie, as a table of marks tells.

The candidates are complete: every pair at or above the threshold is in a tile or connected without. Only hashes can deceive:
shingles and nodes are told apart by 64 bits.

Defined results: a text with fewer words than ``words`` has its whole sequence as one shingle; a null
text or one without words has the empty set, links with nothing and is its own component; repeated rows
are equal sets; ties don't matter, since every link counts; texts of any length are read whole; the component is the
smallest doc_id, null only if no row of the component has one; an empty table gives an empty result; further
columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, cleared, light, pick, saved, slices
from .graph import components

WORDS, PERCENT = 5, 80
#: A shingle that so many documents have comes late in the order of keys; of such at most so many are told apart.
FREQUENT, MOST_FREQUENT = 24, 500_000
#: Shingles are counted in blocks of so many; those that don't recur in a block are left out of the count.
BLOCK_HASHES = 1_000_000
#: One row of so many is read for a count of its first keys over the whole table; one that so many of these rows have is frequent too.
SAMPLED, RECURRING = 8, 6
#: Documents of a frequent shingle for each of the parts that its key is split into.
HOT = 500
#: Weight of a block that is a tile by itself, and of one that meets others (a set weighs its size, or LEAST_WEIGHT if that is more).
BLOCK_WEIGHT, PAIR_WEIGHT, LEAST_WEIGHT = 64_000, 128_000, 128
#: The widest bitmap.
MOST_BITS = 1 << 14
#: Words of which a worker remembers the hashes.
REMEMBERED = 150_000
#: Sizes of a band differ by less than this factor; it exceeds 100 / PERCENT, so only adjacent bands can link.
BAND = 1.26
#: Keys that the nodes of a candidate pair have in common, as far as the threshold allows it.
COMMON = 4
#: Nodes of a key up to which all its pairs are candidates; beyond, its nodes are chained.
ALL_PAIRS = 96
#: Bits of the table of marks for each row that it marks, and the bits at most, as a power of 2.
MARKS, MOST_MARKS = 32, 28
#: Nodes up to which a list of them is broadcast.
BROADCAST_ROWS = 1_000_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def hashes(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        if n < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], np.uint64)
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        m = n - self.words + 1
        s = h[:m].copy()
        for k in range(1, self.words):
            s *= np.uint64(MULTIPLIERS[0])
            s ^= s >> np.uint64(29)
            s += h[k : k + m]
        s *= np.uint64(MULTIPLIERS[1])
        s ^= s >> np.uint64(32)
        s.sort()
        return s[np.append(True, s[1:] != s[:-1])]


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bitmap, frequent): node and bitmap are null for an empty set.

    Besides a row for each document there are rows without size: their ``frequent`` holds hashes of
    shingles that recur among neighbouring documents, with their counts there.
    """
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("n", pa.int64())]))
    names = ["doc_id", "text_key", "n_shingles", "node", "bitmap", "frequent"]

    def recurring(sets: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
        many = counts > 1
        told = pa.StructArray.from_arrays([signed(hashes[many]), pa.array(counts[many].astype(np.int64))], ["hash", "n"])
        none = pa.array([None], pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets, held = Shingler(), [], 0
        for batch in batches:
            sizes, nodes, bitmaps = [], [], []
            for text in batch.column(2):
                s = shingler.hashes(text.as_py() or "")
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                bitmaps.append(bitmap_of(s) if len(s) else None)
                sets.append(s)
                held += len(s)
                if held >= BLOCK_HASHES:
                    yield recurring(sets)
                    sets, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bitmaps, pa.binary()), pa.nulls(len(sizes), kind)], names)
        if held:
            yield recurring(sets)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, bitmap binary, frequent array<struct<hash: bigint, n: bigint>>")


def first_keys(docs: DataFrame, percent: int) -> DataFrame:
    """(hash, n): what is counted among the first keys of one row of SAMPLED, in rows of the table.

    A shingle that is rare in every block of members but common in a large table is only told by this.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, none = Shingler(), np.empty(0, np.uint64)
        for batch in slices(batches, 1000):
            sets = [shingler.hashes(text.as_py() or "") for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([signed(np.concatenate([none, *(prefix(s, none, percent, COMMON + len(s) // 20) for s in sets)]))], ["hash"])

    some = docs.where(F.pmod(row_of("text_key", "doc_id"), F.lit(SAMPLED)) == 0).select("text")
    counted = some.mapInArrow(run, "hash bigint").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING)
    return counted.select("hash", (SAMPLED * F.col("n")).alias("n"))


def frequent_hashes(found: DataFrame, docs: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that come last in the order of keys, at most MOST_FREQUENT of them, sorted; and into how many parts each is split as a key.

    Any set of hashes gives the same links, as long as it is one for all; this one makes few candidates.
    """
    counted = found.where("frequent IS NOT NULL").select(F.explode("frequent").alias("x")).groupBy("x.hash").agg(F.sum("x.n").alias("n")).where(F.col("n") >= FREQUENT)
    counted = counted.union(first_keys(docs, percent)).groupBy("hash").agg(F.max("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "hash").limit(MOST_FREQUENT).toPandas()
    hashes, n = rows["hash"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], (1 + n[order] // HOT).astype(np.int32)


def common_keys(percent: int) -> int:
    """Keys that two similar sets have in common, if they aren't equal: with x of x + 1 in common, x is percent / (100 - percent) at least."""
    return max(1, min(COMMON, percent // max(1, 100 - percent)))


def prefix(hashes: np.ndarray, late: np.ndarray, percent: int, common: int = 1) -> np.ndarray:
    """The first keys of a set: so many of them, ``common``, are in every set that is similar enough."""
    n = len(hashes)
    k = n - (percent * n + 99) // 100 + common
    if not len(late) or k >= n:
        return hashes[:k]
    at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
    last = late[at] == hashes
    early = hashes[~last]
    return early[:k] if len(early) >= k else np.concatenate([early, hashes[last][: k - len(early)]])


def compatible(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    return 100 * small.astype(np.int64) >= percent * large.astype(np.int64)


def pairs_of_keys(key: np.ndarray, node: np.ndarray, n: np.ndarray, percent: int, chained: bool = False) -> pa.RecordBatch:
    """Pairs of whole keys and how many of the keys each has; rows are sorted by key, size and node. chained: the first key is a large one."""
    first = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])) if len(key) else np.empty(0, bool)
    key, node, n = key[first], node[first], n[first]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    large = sizes > ALL_PAIRS
    if chained and len(large):
        large[0] = True
    large = np.repeat(large, sizes)
    a, b, sure = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    for d in range(1, ALL_PAIRS):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        same &= compatible(n[:-d], n[d:], percent)
        if d > 1:
            same &= ~large[d:]
        a.append(node[:-d][same])
        b.append(node[d:][same])
        sure.append(large[d:][same])
    a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
    made, times = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), sure], 1), axis=0, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array(made[:, 2].astype(bool)), pa.array(times.astype(np.int32))], ["a", "b", "chained", "times"])


def runs_of(key: int, node: np.ndarray, n: np.ndarray, percent: int) -> list[tuple[int, int, int, int]]:
    """(key, node, lo, hi) of each run of compatible sizes of a part of a split key; rows are sorted by size and node."""
    edges = [0, *(np.flatnonzero(~compatible(n[:-1], n[1:], percent)) + 1).tolist(), len(n)]
    return [(key, int(node[a]), int(n[a]), int(n[b - 1])) for a, b in zip(edges, edges[1:])]


def candidate_pairs(docs: DataFrame, late: np.ndarray, parts: np.ndarray, percent: int) -> DataFrame:
    """(a, b, chained), a < b: nodes that share enough keys, or a chained one, and are of compatible sizes."""
    schema = "a bigint, b bigint, chained boolean, times int, hot bigint, lo int, hi int"
    common = common_keys(percent)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, 1000):
            made, nodes, sizes = [np.empty(0, np.uint64)], [], []
            for text in batch.column(0):
                s = shingler.hashes(text.as_py() or "")
                if len(s):
                    made.append(prefix(s, late, percent, common))
                    nodes.append(node_of(s))
                    sizes.append(len(s))
            times = [len(x) for x in made[1:]]
            key, node = np.concatenate(made), np.repeat(np.array(nodes, np.int64), times)
            part = np.full(len(key), -1, np.int32)
            if len(late):
                at = np.minimum(np.searchsorted(late, key), len(late) - 1)
                split = (late[at] == key) & (parts[at] > 1)
                part[split] = (node[split].view(np.uint64) % parts[at][split].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([signed(key), pa.array(part), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), times))], ["key", "part", "node", "n"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chained = None, False

        def told(key: np.ndarray, part: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for some, hot in ((part < 0, False), (part >= 0, True)):
                if not some.any():
                    continue
                if not hot:
                    made = pairs_of_keys(key[some], node[some], n[some], percent, chained)
                    empty = pa.nulls(made.num_rows)
                    yield pa.RecordBatch.from_arrays([*made.columns, empty.cast(pa.int64()), empty.cast(pa.int32()), empty.cast(pa.int32())], [*made.schema.names, "hot", "lo", "hi"])
                    continue
                cells = np.flatnonzero(np.append(True, (key[some][1:] != key[some][:-1]) | (part[some][1:] != part[some][:-1]))).tolist()
                for a, b in zip(cells, [*cells[1:], int(some.sum())]):
                    own, sizes = node[some][a:b], n[some][a:b]
                    first = np.append(True, own[1:] != own[:-1])
                    own, sizes = own[first], sizes[first]
                    near = compatible(sizes[:-1], sizes[1:], percent)
                    left, right = own[:-1][near], own[1:][near]
                    runs = runs_of(int(key[some][a]), own, sizes, percent)
                    columns = [np.minimum(left, right), np.maximum(left, right), np.ones(len(left), bool)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays([pa.array(columns[0]), pa.array([r[1] for r in runs], pa.int64())]),
                            pa.concat_arrays([pa.array(columns[1]), pa.nulls(len(runs), pa.int64())]),
                            pa.concat_arrays([pa.array(columns[2]), pa.array([True] * len(runs))]),
                            pa.array(np.ones(len(left) + len(runs), np.int32)),
                            pa.concat_arrays([pa.nulls(len(left), pa.int64()), pa.array([r[0] for r in runs], pa.int64())]),
                            pa.concat_arrays([pa.nulls(len(left), pa.int32()), pa.array([r[2] for r in runs], pa.int32())]),
                            pa.concat_arrays([pa.nulls(len(left), pa.int32()), pa.array([r[3] for r in runs], pa.int32())]),
                        ],
                        ["a", "b", "chained", "times", "hot", "lo", "hi"],
                    )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.append(h, r) for h, r in zip(held, rows)]
            key, part = rows[0], rows[1]
            last = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))[-1])
            if last:
                yield from told(*(r[:last] for r in rows))
                chained = False
            held = [r[last:] for r in rows]
            if held[1][0] < 0 and len(held[0]) > 4 * ALL_PAIRS:  # a key may have any number of rows: only its last stays
                if chained or len(np.unique(held[2])) > ALL_PAIRS:
                    chained = True
                    yield from told(*held)
                    held = [h[-1:] for h in held]
                else:
                    first = np.append(True, held[2][1:] != held[2][:-1])
                    held = [h[first] for h in held]
        if held is not None:
            yield from told(*held)

    keyed = docs.select("text").mapInArrow(keys, "key bigint, part int, node bigint, n int")
    made = saved(keyed.repartition("key", "part").sortWithinPartitions("key", "part", "n", "node").mapInArrow(pairs, schema), "key-pairs")
    # the runs of a split key, one after the other by size
    order = W.partitionBy("hot").orderBy("lo", "hi", "a")
    runs = made.where("hot IS NOT NULL").select("hot", "a", "lo", "hi")
    after = runs.select(F.lag("a").over(order).alias("x"), F.col("a").alias("y"), "lo", F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("reach"))
    bridges = after.where((F.col("x") != F.col("y")) & (100 * F.col("reach") >= percent * F.col("lo"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(True).alias("chained"), F.lit(1).alias("times"))
    met = made.where("hot IS NULL").select("a", "b", "chained", "times").union(bridges).groupBy("a", "b").agg(F.max("chained").alias("chained"), F.sum("times").alias("times"))
    return met.where(F.col("chained") | (F.col("times") >= common)).select("a", "b", "chained")


def bitmap_of(hashes: np.ndarray) -> bytes:
    """Hashed bits of a set; narrower ones follow by joining the halves, since a bit's place is the low bits of its hash."""
    bits = min(MOST_BITS, 1 << max(6, int(2 * len(hashes) - 1).bit_length()))
    out = np.zeros(bits, np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_link(bits_a: bytes, n_a: int, bits_b: bytes, n_b: int, percent: int) -> bool:
    """False if the bit counts rule the pair out."""
    a, b = int.from_bytes(bits_a, "little"), int.from_bytes(bits_b, "little")
    wide_a, wide_b = 8 * len(bits_a), 8 * len(bits_b)
    while wide_a > wide_b:
        wide_a //= 2
        a = (a >> wide_a) | (a & ((1 << wide_a) - 1))
    while wide_b > wide_a:
        wide_b //= 2
        b = (b >> wide_b) | (b & ((1 << wide_b) - 1))
    most = min(n_a - (a & ~b).bit_count(), n_b - (b & ~a).bit_count())
    return 100 * most >= percent * (n_a + n_b - most)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays of distinct hashes have that Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is similar in a tile. side: 0 or 1 where only pairs of both sides count, else all 0. known: components so far."""
    nodes, first = np.unique(nodes, return_index=True)
    sets, side = [sets[i] for i in first], side[first]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(sizes, kind="stable")
    group = np.arange(len(sets)) if known is None else np.unique(known[first], return_inverse=True)[1][order]
    nodes, sets, side, sizes = nodes[order], [sets[i] for i in order], side[order], sizes[order]
    count, crossing = len(sets), bool(side.any())
    bits = min(MOST_BITS, 1 << max(6, int(2 * sizes[-1] - 1).bit_length()))
    bitmap = np.zeros((count, bits // 8), np.uint8)
    own = np.repeat(np.arange(count), sizes)
    at = np.concatenate(sets) & np.uint64(bits - 1)
    np.bitwise_or.at(bitmap, (own, (at >> np.uint64(3)).astype(np.int64)), np.left_shift(1, (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
    bitmap = bitmap.view(np.uint64)
    past = np.searchsorted(sizes, (100 * sizes) // percent, "right")
    linked: list[tuple[int, int]] = []
    step = max(1, (4 << 20) // bitmap.shape[1])
    for i in range(count):
        lo, end = i + 1, int(past[i])
        while lo < end:
            hi = min(end, lo + step)
            j = np.flatnonzero(group[lo:hi] != group[i]) + lo
            if crossing:
                j = j[side[j] != side[i]]
            if len(j):
                only = np.bitwise_count(bitmap[i] & ~bitmap[j]).sum(1, dtype=np.int64)
                other = np.bitwise_count(bitmap[j] & ~bitmap[i]).sum(1, dtype=np.int64)
                most = np.minimum(sizes[i] - only, sizes[j] - other)
                for k in j[100 * most >= percent * (sizes[i] + sizes[j] - most)].tolist():
                    if group[k] != group[i] and similar(sets[i], sets[k], percent):
                        group[group == group[k]] = group[i]
                        linked.append((i, k))
            lo = hi
    pairs = np.array(linked, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def weight() -> F.Column:
    return F.sum(F.greatest("n", F.lit(LEAST_WEIGHT)))


def blocks_of(active: DataFrame, by: list[str], shift: float, salt: int, most: int) -> DataFrame:
    """active with band and block: the nodes of a band, and of what else is in ``by``, in blocks of about the weight ``most``."""
    banded = active.withColumn("band", F.floor(F.log("n") / math.log(BAND) + F.lit(shift)).cast("int"))
    many = banded.groupBy(*by, "band").agg(F.ceil(weight() / most).cast("int").alias("blocks"))
    return banded.join(many, [*by, "band"]).withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "node"), F.col("blocks")).cast("int")).drop("blocks")


def tile_of(*parts: str | F.Column) -> F.Column:
    return F.xxhash64(*parts)


def home_tiles(active: DataFrame, salt: int) -> DataFrame:
    """(tile, side, node, known): one tile a node. active: node, family, n and heavy."""
    dealt = blocks_of(active, ["family"], 0.5 * salt, salt, BLOCK_WEIGHT)
    tile = F.when(F.col("heavy"), tile_of(F.lit(salt), "family", "band", "block")).otherwise(tile_of("family"))
    return dealt.select(tile.alias("tile"), F.lit(2).alias("side"), "node", F.col("node").alias("known"))


def pair_tiles(active: DataFrame) -> DataFrame:
    """(tile, side, node, known): blocks of the same or adjacent bands of a family, but for two blocks of its main component. active: node, family, n, known and main."""
    dealt = saved(blocks_of(active, ["family", "main"], 0.0, 2, PAIR_WEIGHT), "dealt")
    blocks = dealt.select("family", "main", "band", "block").distinct()
    ends = [blocks.select("family", *(F.col(c).alias(f"{c}_{x}") for c in ("main", "band", "block"))) for x in "ab"]
    up = ends[0].withColumn("band_b", F.explode(F.array(F.col("band_a"), F.col("band_a") + 1)))
    met = up.join(ends[1], ["family", "band_b"]).where(~(F.col("main_a") & F.col("main_b")))
    met = met.where((F.col("band_a") < F.col("band_b")) | (F.struct("main_a", "block_a") <= F.struct("main_b", "block_b")))
    met = met.withColumn("tile", tile_of("family", "main_a", "band_a", "block_a", "main_b", "band_b", "block_b"))
    one = (F.col("band_a") == F.col("band_b")) & (F.col("main_a") == F.col("main_b")) & (F.col("block_a") == F.col("block_b"))
    sides = [met.where(~one | F.lit(x == "a")).select("family", *(F.col(f"{c}_{x}").alias(c) for c in ("main", "band", "block")), "tile", F.when(one, 2).otherwise(int(x == "b")).alias("side")) for x in "ab"]
    tiles = saved(sides[0].unionByName(sides[1]), "tiles")
    return dealt.join(light(tiles, BROADCAST_ROWS // 10), ["family", "main", "band", "block"]).select("tile", "side", "node", "known")


def row_of(text_key: str, doc_id: str) -> F.Column:
    return F.xxhash64(text_key, doc_id)


def marks_of(rows: np.ndarray) -> np.ndarray:
    """A table with a bit set for each row hash, of bounded size."""
    bits = min(MOST_MARKS, max(10, (MARKS * len(rows)).bit_length()))
    table = np.zeros(1 << bits, bool)
    table[(rows.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(table, bitorder="little")


def marked(rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether the table has a row's bit: true of all that it was made from and of few others."""
    at = (rows.view(np.uint64) >> np.uint64(65 - (8 * len(marks)).bit_length())).astype(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def is_marked(rows: DataFrame) -> Callable[[F.Column], F.Column]:
    """A function of a column of row hashes: true of all that rows, one column, has, and of few others. Only the hashes go to Python."""
    marks = marks_of(rows.toArrow().column(0).to_numpy())

    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            yield pd.Series(marked(hashes.to_numpy(np.int64), marks))

    return F.pandas_udf(asked, "boolean")


def sets_of(docs: DataFrame, found: DataFrame, nodes: DataFrame, kept: Scratch) -> DataFrame:
    """(node, n, members): the sets of the listed nodes, each from one row of docs, and of a few other nodes, which later joins leave out."""
    # of the copies of a text one row is read
    best = found.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("of")).join(nodes, "node", "left_semi")
    marks = marks_of(best.select(row_of("of.text_key", "of.doc_id")).toArrow().column(0).to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices((b.filter(pa.array(marked(b.column(0).to_numpy(), marks))) for b in batches), 200):
            sets = [s for text in batch.column(1) if len(s := shingler.hashes(text.as_py() or ""))]
            told = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(told, ["node", "n", "members"])

    return kept(docs.select(row_of("text_key", "doc_id"), "text").mapInArrow(run, "node bigint, n bigint, members binary"), now=True)


def bounded_pairs(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that the bit counts leave, and the chained ones."""
    some = pairs.where("NOT chained")
    wanted = some.select(F.col("a").alias("node")).union(some.select("b")).distinct()
    signs = saved(bitmaps.where("node IS NOT NULL").dropDuplicates(["node"]).join(wanted, "node", "left_semi"), "bitmaps")
    sides = [signs.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bits_{x}")) for x in "ab"]
    met = some.join(sides[0], "a").join(sides[1], "b").select("a", "b", "bits_a", "n_a", "bits_b", "n_b")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            left = pa.array([may_link(*x, percent) for x in zip(*(c.to_pylist() for c in batch.columns[2:]))], pa.bool_())
            yield batch.select(["a", "b"]).filter(left)

    return met.mapInArrow(bound, "a bigint, b bigint").union(pairs.where("chained").select("a", "b"))


def compared(sets: DataFrame, tiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar in a tile."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, nodes, sides, knowns, sets = None, [], [], [], []

        def told() -> pa.RecordBatch:
            side = np.array(sides)
            crossing = not (side == 2).any()
            a, b = tile_links(np.array(nodes, np.int64), sets, side if crossing else np.zeros(len(side), np.int64), percent, np.array(knowns, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(batches, 500):
            for tile, side, node, known, own in zip(*(c.to_pylist() for c in batch.columns)):
                if tile != held and len(nodes) > 1:
                    yield told()
                if tile != held:
                    held, nodes, sides, knowns, sets = tile, [], [], [], []
                nodes.append(node)
                sides.append(side)
                knowns.append(known)
                sets.append(np.frombuffer(own, np.uint64))
        if len(nodes) > 1:
            yield told()

    dealt = sets.select("node", "members").join(tiles, "node").select("tile", "side", "node", "known", "members")
    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "a bigint, b bigint")


def exact_links(sets: DataFrame, families: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is similar. families: node, component."""
    active = sets.select("node", "n").dropDuplicates(["node"]).join(families.withColumnRenamed("component", "family"), "node")
    whole = active.groupBy("family").agg((weight() > BLOCK_WEIGHT).alias("heavy"))
    active = saved(active.join(whole, "family"), "active")
    found = saved(compared(sets, home_tiles(active, 0), percent), "home-links")
    cleared(sets.sparkSession)
    heavy = active.where("heavy")
    if not heavy.head(1):
        return found
    again = saved(compared(sets, home_tiles(heavy, 1), percent), "home-links")
    cleared(sets.sparkSession)
    known = components(found.union(again))
    heavy = heavy.join(known, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")
    main = heavy.groupBy("family", "known").agg(weight().alias("weight")).groupBy("family").agg(F.max(F.struct("weight", "known")).alias("top"), F.count("*").alias("several"))
    main = main.where("several > 1").select("family", F.col("top.known").alias("largest"))
    apart = heavy.join(main, "family").select("node", "family", "n", "known", (F.col("known") == F.col("largest")).alias("main"))
    return found.union(again).union(compared(sets, pair_tiles(apart), percent))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, component_id and group (the component's smallest node; null for an empty set)."""
    keyed = pick(docs, "doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    told = saved(members(keyed), "members")
    found = told.where("n_shingles IS NOT NULL").drop("frequent")
    bitmaps = found.select("node", F.col("n_shingles").alias("n"), "bitmap")
    with Scratch() as kept:
        frequent = frequent_hashes(told, keyed, percent)
        cleared(docs.sparkSession)
        pairs = saved(candidate_pairs(keyed, *frequent, percent), "pairs")
        cleared(docs.sparkSession)
        families = components(bounded_pairs(pairs, bitmaps, percent))
        joined = components(exact_links(sets_of(keyed, found, families, kept), families, percent))
    # names are given to nodes first: a group of any size meets its smallest id there, not row by row
    least = found.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    low = saved(joined.join(least, "node").groupBy("component").agg(F.min("least").alias("lowest")), "lowest")
    linked = joined.join(light(low, BROADCAST_ROWS), "component")
    named = saved(least.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("group"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id")), "named")
    met = found.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left")
    return met.select("doc_id", "text_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group")
