"""Connected components over an edge table, by alternating large and small stars.

Each round is joins and aggregations over (u, v) pairs of longs; the edges stay distributed and are written to the
shared folder once a round.  The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and every neighbour below it are linked to the least of those neighbours (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the least node reachable.

    Order of ends, repeats and self-links do not matter; nulls are dropped.  A node without a link to another has no row.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges, seen = scratch.table(edges), None
    for _ in range(max_rounds):
        old, edges = edges, scratch.table(_small_star(_large_star(edges)))
        scratch.remove(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
