"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def _attach(edges: DataFrame, smaller_too: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) hang on
    the smallest node it sees. Both sides of the join are as large as the edge table."""
    if smaller_too:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        moved = both.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    else:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = both.where("b > a").join(least.hint("merge"), "a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """For edges ``a, b`` of longs: ``node`` and ``root``, the smallest node it is
    connected with, for every node that is not a root itself.

    Each round is written to the shared folder, so lost executors cost one round at
    most. A round moves every node nearer to its root; the rounds are of the order of
    the logarithm of the longest chain. No edges give no rows.
    """
    now = cut_lineage(edges.where("a <> b").select("a", "b").distinct())
    seen = None
    for _ in range(rounds):
        round_ = Observation()
        now = cut_lineage(_attach(_attach(now, False), True).observe(
            round_, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("mark")))
        mark = round_.get
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
