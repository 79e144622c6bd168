"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import cut_lineage


def _lowest(arrows: DataFrame) -> DataFrame:
    """Per node ``u`` the lowest ``v`` it points to; sums up before the shuffle, so that a hub is one row a task."""
    return arrows.groupBy("u").agg(F.min("v").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (``u``, ``v``: long) with ``component``, the lowest node they reach.

    Each round points every node at the lowest node of its neighbourhood and is stored in the shared
    folder; rounds end when a round changes nothing. Loops and repeated edges do no harm. Joins on a hub
    are left to the engine's skew handling. Nodes without an edge to another node are not returned.
    """
    arrows = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
    )
    arrows = cut_lineage(arrows.distinct(), "edges")
    mark = _mark(arrows)
    while True:
        # Large star: neighbours above a node point at the lowest of the node and its neighbours.
        both = arrows.unionByName(arrows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("low", "u").alias("low"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # Small star: a node and the lower ones it points at point at the lowest of these.
        large = cut_lineage(large.where(F.col("u") != F.col("v")).distinct(), "stars")
        low = _lowest(large)
        moved = large.join(low, "u").where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        arrows = cut_lineage(moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(arrows)
        if mark == before:
            return arrows.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(arrows: DataFrame) -> tuple[int, int]:
    """Count of the arrows and a sum of their hashes: equal for equal sets of arrows."""
    row = arrows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])
