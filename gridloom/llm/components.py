"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

#: edges that one task may solve at once (16 bytes each); it never gets more, since they are counted first
ONE_TASK = 300_000


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over links (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all edges (u, v) of a partition."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(node, component) for every end of ``edges`` (u, v; longs): component is the smallest node reachable.

    Every step is a grouped minimum (combined before the shuffle) and a join with the table of minima; that
    table is written first, so both sides of the join are plain shuffles and Spark can split a hot centre.
    Nothing is collected but two numbers per round; rounds grow with the logarithm of the longest chain. Edges that were
    counted to be at most ``ONE_TASK`` are solved in one task instead of in rounds.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), tag)
    state = _state(now)
    while state[0]:
        if state[0] <= ONE_TASK:
            return now.coalesce(1).mapInArrow(_solve, "node long, component long")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), tag)
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag)
        least2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        moved = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(moved.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), tag)
        for old in (now, least, large, least2):
            discard(old)
        now, before = new, state
        if (state := _state(now)) == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
