"""Connected components of a graph of long ids, by alternating large-star and small-star steps.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.) Each step is an aggregation for the least
neighbour and a join back, so no neighbour list is gathered in one place; each round is written to the shared folder.
Rounds grow with the logarithm of a component's diameter. They end when the edges are stars, which one aggregation tells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return kept.union(least.select("a", F.col("m").alias("b"))).distinct()


def _of_stars(edges: DataFrame) -> bool:
    """Whether each node has one lower neighbour, or only higher ones."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).union(edges.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    mixed = ends.groupBy("v").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR (up = 1 AND least = 0)")
    return mixed.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component. Loops add nothing."""
    cur = staged(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _of_stars(cur):
        cur = staged(_small_star(_large_star(cur)), "edges")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
