"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour instead."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    moved = joined.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.where("a < b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b); a component is named by its least node."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "components")
    while not _settled(edges):
        edges = materialize(_small_star(_large_star(edges)), "components")
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
