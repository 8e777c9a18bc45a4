"""Connected components of links between documents or vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Links that one task finishes; more are contracted by rounds over all executors first.
ONE_TASK = 2_000_000


def labels(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes, sorted, and for each the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v = at[: len(src)], at[len(src) :]
    parent = np.arange(len(nodes))
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return nodes, nodes[parent]
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a partition by one from each node to the smallest that it reaches."""
    src, dst = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        src = np.concatenate([src, batch.column(0).to_numpy(zero_copy_only=False)])
        dst = np.concatenate([dst, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(src) >= 1 << 20:
            src, dst = labels(src, dst)
    if len(src):
        src, dst = labels(src, dst)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["node", "component"])


def _rounds(links: DataFrame) -> DataFrame:
    """Large-star and small-star rounds until every node is linked to its component's smallest, or few links are left.

    Links point from a node to a smaller one. Minima are aggregated before they are dealt out, and a
    node with very many links is split by Spark's skew join.
    """
    while True:
        both = links.union(links.select(F.col("component"), F.col("node")))
        low = both.groupBy("node").agg(F.min("component").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.where("component > node").join(low, "node").select(F.col("component").alias("node"), F.col("low").alias("component")).where("node > component").distinct()
        small_low = large.groupBy("node").agg(F.min("component").alias("low"))
        small = large.join(small_low, "node").select(F.explode(F.array(F.struct(F.col("component").alias("node"), F.col("low").alias("component")), F.struct("node", F.col("low").alias("component")))).alias("x")).select("x.*")
        after = saved(small.where("node > component").distinct(), "links")
        if after.count() <= ONE_TASK or not after.exceptAll(links).head(1):
            return after
        links = after


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of a link the smallest node that it reaches.

    links: two bigint columns without nulls; order, repetition and self-links don't matter.
    """
    a, b = links.columns
    # what makes links is often Python too: written first, a task never holds two Python workers
    links = saved(links, "raw-links")
    forest = saved(links.select(F.col(a).alias("node"), F.col(b).alias("component")).mapInArrow(_forest, "node bigint, component bigint"), "forest")
    if forest.count() > ONE_TASK:
        stars = _rounds(forest.where("node > component"))
        alone = forest.select("node").union(forest.select("component")).distinct()
        if stars.count() > ONE_TASK:
            return alone.join(stars.groupBy("node").agg(F.min("component").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        forest = stars.union(alone.select("node", F.col("node").alias("component")))
    return saved(forest.coalesce(1).mapInArrow(_forest, "node bigint, component bigint"), "components")
