"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedlane.plans.layout import settled

ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``(a, b)`` but the roots; a root is its component's smallest node.

    Large and small stars by turns (Kiveris et al., 2014): every node's larger, then smaller, neighbours
    are linked to its smallest one, until nothing changes. Each turn is kept as files, so a lost executor
    repeats one turn at most. Rows are counted and joined, never gathered per node.
    """
    now = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        stars = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        stars = settled(stars)
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        linked = stars.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settled(
            linked.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
