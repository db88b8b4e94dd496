"""Connected components of an edge table by alternating large-star and small-star steps; few edges in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, stage_measured

#: Edges that one task takes at once: every round of steps costs the driver two queries, whatever its size.
AT_ONCE = 500_000


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted nodes of the edges, and for each the smallest node it reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _at_once(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            nodes, roots = roots_of(*(np.concatenate(x) for x in zip(*got, strict=True)))
            moved = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], names=["node", "root"])

    return stage(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long"), "roots")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge to its root or is a root itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).where("n > 1").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(u, v) edges of longs, u > v, to (node, root): every node's smallest reachable node.

    Only mins are kept for a node, never its list of neighbours, so a hub costs
    no task more than its share; each round is staged, and the loop ends when the edges are
    stars.  Up to ``at_once`` edges are solved in one task instead, with the same result.
    Roots that are their own are left out.
    """
    edges, seen = stage_measured(edges.distinct(), "edges", F.count(F.lit(1)).alias("n"))
    if seen["n"] <= at_once:
        return _at_once(edges)
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = stage(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
