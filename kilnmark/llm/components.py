"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    met = both.join(least, "a")
    if large:  # larger neighbours to the least one
        return met.filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # smaller neighbours and the node itself to the least one
    hung = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs from one other at most, and none that hangs from one has others hanging from it."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return seen.isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the least id reachable, for every id that has an edge. ``edges``: a, b; null ids are ignored.

    Each step moves two-column rows only, with map-side minima, so that a hub with a third of all edges costs one
    partial row per task; no component is ever gathered."""
    cur = scratch.cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    while not _stars(cur):
        cur = scratch.cut(_star(_star(cur, True), False).distinct(), "star")
    leaves = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
