"""Embedding near-dedup by product quantisation over coarse inverted lists.

Equal vectors of a label are one node. Unit vectors are assigned to the nearest of a few centroids
(their inverted list), and their residual is coded by the nearest codeword in each subspace. A query
probes every list that can hold a vector within the radius of the threshold: the plane between its own
centroid and another one bounds the distance from below, so no list is left out by chance. In a list, table
lookups give the distance to each code; since the error of every code is kept with it, a code farther
than the radius plus that error cannot be a link. What is left is decided by the exact cosine of the
vectors in double precision. Hence all links at or above the threshold are found, and none below.

Centroids and codewords are fitted on at most ``SAMPLE`` vectors (the first by a hash) of each of the
``SHAPES`` most frequent vector lengths; they decide how much work there is, not what is found: vectors of other
lengths are one list a label, whose codes say nothing. Lists are dealt out to blocks of ``BLOCK`` vectors, several lists to a
block or several blocks to a list; a query goes to the blocks of its lists, once to each, and the queries of a block
are dealt out again, so a task compares at most about ``BLOCK`` queries with as many vectors, list by list.
A vector thus travels once for each block of its label that it probes, not once a list. A task
reports counts for its queries and the links that join components, not all pairs.

Defined results: vectors that are null, zero, or hold a null or non-finite component, and those without
a label, link with nothing and are their own component; vectors of different length don't link; copies
link with each other and count with every other row; rows without vec_id link like others, and a
component is null only if none of its rows has an id; ties don't matter, since every link counts; an empty table
gives an empty result; further columns, also with clashing names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import light, pick, saved, slices
from .graph import components, labels

THRESHOLD = 0.93
#: Vectors that centroids and codewords are fitted on, vectors of a list as aimed at, the most lists of a label, and vector lengths with a fit.
SAMPLE, LIST_SIZE, MOST_LISTS, SHAPES = 4096, 1000, 1024, 16
#: Subspaces, codewords of each, and vectors of a block.
SUBSPACES, CODEWORDS, BLOCK = 8, 16, 16_384


#: Rows up to which lists and blocks, or components, are broadcast.
BROADCAST_ROWS = 100_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the rows of x; the first ones are rows far from each other."""
    k = min(k, len(x))
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    for _ in range(k - 1):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centers = x[chosen].copy()
    for _ in range(rounds):
        of = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return squares(x, centers).argmin(1)


@dataclass
class Quantiser:
    """Centroids of the lists, and codewords of each subspace of the residuals."""

    centers: np.ndarray
    words: list[np.ndarray]
    cuts: list[tuple[int, int]]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Quantiser:
        centers = kmeans(x, lists)
        rest = x - centers[nearest(x, centers)]
        edges = [x.shape[1] * i // SUBSPACES for i in range(SUBSPACES + 1)]
        cuts = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
        return cls(centers, [kmeans(rest[:, a:b], CODEWORDS) for a, b in cuts], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For unit vectors: their list, codes, and the error of the codes."""
        of = nearest(x, self.centers)
        rest = x - self.centers[of]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.cuts, self.words)], 1).astype(np.uint8)
        decoded = np.hstack([w[codes[:, i]] for i, w in enumerate(self.words)])
        return of, codes, np.linalg.norm(rest - decoded, axis=1)

    def probes(self, x: np.ndarray, of: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within the radius of each unit vector."""
        d = squares(x, self.centers)
        apart = np.sqrt(squares(self.centers, self.centers))[of]
        beyond = d - d[np.arange(len(x)), of][:, None]
        return beyond <= 2 * radius * apart + 1e-9

    def distances(self, x: np.ndarray, k: int, codes: np.ndarray) -> np.ndarray:
        """By table lookup, from each unit vector to each code of list k."""
        rest = x - self.centers[k]
        total = np.zeros((len(x), len(codes)))
        for i, ((a, b), w) in enumerate(zip(self.cuts, self.words)):
            total += squares(rest[:, a:b], w)[:, codes[:, i]]
        return np.sqrt(total)


    @classmethod
    def trivial(cls, size: int) -> Quantiser:
        """One list, whose codes are all the same: every pair is decided exactly."""
        return cls(np.zeros((1, size)), [np.zeros((1, size))], [(0, size)])


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """The vectors of a column of bytes, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding and node; node is null for what links with nothing."""
    rows = pick(vectors, "vec_id", "embedding", "label")
    if rows.schema["embedding"].dataType.elementType.typeName() != "float":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    whole = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))
    return rows.withColumn("node", F.when(whole, F.xxhash64("label", F.size("embedding"), "embedding")))


def quantisers(reps: DataFrame, kind: type) -> dict[int, Quantiser]:
    """One for each of the most frequent vector lengths, fitted on a bounded sample."""
    shape = reps.groupBy("size").agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).orderBy(F.desc("n"), "size").limit(SHAPES).collect()
    made = {}
    for s in shape:
        rows = reps.where(F.col("size") == s["size"]).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
        lists = max(1, min(MOST_LISTS, math.ceil(s["n"] / max(1, s["labels"]) / LIST_SIZE), len(rows)))
        made[s["size"]] = Quantiser.fit(unit(matrix(rows, kind)), lists)
    return made


def indexed(reps: DataFrame, made: dict[int, Quantiser], radius: float, kind: type) -> DataFrame:
    """Each node with its list, codes, error and probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                x, q = unit(matrix(part.column("vector"), kind)), made.get(size) or Quantiser.trivial(size)
                of, codes, error = q.encode(x)
                probes = q.probes(x, of, radius)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in ("node", "copies", "label", "size", "vector")), pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([np.flatnonzero(p).astype(np.int32) for p in probes], pa.list_(pa.int32()))],
                    ["node", "copies", "label", "size", "vector", "list", "codes", "error", "probes"],
                )

    return reps.mapInArrow(run, "node bigint, copies bigint, label bigint, size int, vector binary, list int, codes binary, error double, probes array<int>")


def blocks_of(index: DataFrame, block: int) -> DataFrame:
    """(label, size, list, first, blocks): the blocks of each list. Short lists share one, a long one has several."""
    counts = index.groupBy("label", "size", "list").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("label", "size").orderBy("list")) - F.col("n")  # at most MOST_LISTS rows a partition
    return counts.select("label", "size", "list", F.floor(before / block).cast("int").alias("first"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))


def links_of(index: DataFrame, made: dict[int, Quantiser], threshold: float, radius: float, kind: type) -> DataFrame:
    """(node, links, other): for each task's queries how many rows they link with, and links that join components."""
    cell, own = ["label", "size", "list"], F.pmod(F.xxhash64("node"), F.lit(1 << 30)).cast("int")
    dealt = saved(blocks_of(index, BLOCK), "blocks")
    lists = light(dealt, BROADCAST_ROWS)
    stored = index.join(lists, cell).withColumn("i", F.col("first") + own % F.col("blocks"))
    wanted = index.select("node", "label", "size", F.explode("probes").alias("list")).join(lists, cell)
    wanted = wanted.select("node", "label", "size", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("i")).distinct()
    asking = saved(wanted.groupBy("label", "size", "i").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asking")), "asking")
    asked = wanted.join(light(asking, BROADCAST_ROWS), ["label", "size", "i"]).join(index.select("node", "vector", "probes"), "node")
    there = stored.join(light(asking, BROADCAST_ROWS), ["label", "size", "i"]).select("label", "size", "i", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("j"), F.lit(1).alias("stored"), "node", "copies", "vector", "list", "codes", "error", F.lit(None).cast("array<int>").alias("probes"))
    here = asked.select("label", "size", "i", (own % F.col("asking")).alias("j"), F.lit(0).alias("stored"), "node", F.lit(0).cast("bigint").alias("copies"), "vector", F.lit(-1).alias("list"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), "probes")
    tile = ["label", "size", "i", "j"]

    def meet(size: int, stored: pa.Table, asked: pa.Table) -> pa.RecordBatch:
        quantiser = made.get(size) or Quantiser.trivial(size)
        node, x = asked.column("node").to_numpy(), unit(matrix(asked.column("vector").combine_chunks(), kind))
        probes = asked.column("probes").combine_chunks()
        asker, probed = np.repeat(np.arange(len(node)), np.diff(probes.offsets.to_numpy())), probes.flatten().to_numpy()
        own, copies, error, of = (stored.column(n).to_numpy() for n in ("node", "copies", "error", "list"))
        y = unit(matrix(stored.column("vector").combine_chunks(), kind))
        codes = np.frombuffer(b"".join(stored.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
        counts = np.zeros(len(node), np.int64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.unique(of).tolist():
            inside, asks = np.flatnonzero(of == k), asker[probed == k]
            step = max(1, 4_000_000 // max(1, len(inside)))
            for at in range(0, len(asks), step):
                rows = asks[at : at + step]
                q, i = np.nonzero(quantiser.distances(x[rows], k, codes[inside]) <= radius + error[inside] + 1e-9)
                q, i = rows[q], inside[i]
                for cut in range(0, len(q), 1 << 16):
                    qs, js = q[cut : cut + (1 << 16)], i[cut : cut + (1 << 16)]
                    near = (np.einsum("ij,ij->i", x[qs], y[js]) >= threshold) & (node[qs] != own[js])
                    qs, js = qs[near], js[near]
                    np.add.at(counts, qs, copies[js])
                    if len(qs):
                        left, right = labels(node[qs], own[js])
                        a.append(left)
                        b.append(right)
        some = counts > 0
        left, right = np.concatenate(a), np.concatenate(b)
        if len(left):
            left, right = labels(left, right)
        n, m = int(some.sum()), len(left)
        return pa.RecordBatch.from_arrays([pa.array(np.append(node[some], left)), pa.array([*counts[some].tolist(), *[None] * m], pa.int64()), pa.array([*[None] * n, *right.tolist()], pa.int64())], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def told() -> pa.RecordBatch | None:
            table = pa.Table.from_batches(parts)
            side = table.column("stored").to_numpy()
            stored, asked = (table.filter(pa.array(side == s)) for s in (1, 0))
            return meet(held[1], stored, asked) if stored.num_rows and asked.num_rows else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in tile], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(edges, edges[1:]):
                key = tuple(keys[s].tolist())
                if key != held:
                    if parts and (out := told()) is not None:
                        yield out
                    held, parts = key, []
                parts.append(batch.slice(s, e - s))
        if parts and (out := told()) is not None:
            yield out

    return there.unionByName(here).repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "node bigint, links bigint, other bigint")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    radius = math.sqrt(2 - 2 * threshold) + 1e-6
    rows = nodes_of(vectors)
    kind = np.float32 if rows.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, kind) for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["node", "copies", "label", "size", "vector"])

    distinct = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.first(F.xxhash64("label")).alias("label"), F.first("embedding").alias("embedding"))
    reps = saved(distinct.mapInArrow(as_bytes, "node bigint, copies bigint, label bigint, size int, vector binary"), "vectors")
    made = quantisers(reps, kind)
    found = saved(links_of(saved(indexed(reps, made, radius, kind), "index"), made, threshold, radius, kind), "vector-links")
    counts = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other IS NOT NULL").select("node", "other"))
    told = reps.select("node", "copies").join(counts, "node", "left").join(joined, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"))
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"))
    lowest = saved(told.join(least, "node").groupBy("group").agg(F.min("least").alias("lowest")), "lowest")
    named = saved(told.join(light(lowest, BROADCAST_ROWS), "group").select("node", "n_links", "lowest"), "named")
    out = rows.select("vec_id", "node").join(named, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("lowest")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
