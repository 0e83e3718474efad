"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from umbra.llm.common import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger or the smaller ones) are tied to the smallest of them and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    tied = near.where("b > a") if large else near
    out = tied.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node has one parent, and no parent has one. Steps keep classes, so each is then one star."""
    several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    between = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
    return several.unionByName(between).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (a, b).

    Rounds are logarithmic in the size of a component; each is written to the checkpoint folder.
    """
    now = cut(edges.where("a <> b").select("a", "b").distinct())
    while not _settled(now):
        now = cut(_step(_step(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
