"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b), longs, any direction, repeats and loops allowed -> (node, root): the least node of its component.

    Nodes without an edge to another node do not appear. Every step is a join and an aggregate with map-side
    combining, so a hub's rows are never gathered in one task (AQE splits its partition); a round's edges are
    a table in the shared folder.
    """
    canonical = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, seen = written(canonical(edges)), None
    while True:  # the steps settle in O(log^2) rounds
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        discard(current)
        current = after
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
