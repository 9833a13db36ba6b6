"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``: root is the smallest node of its component.

    Each round aggregates a minimum per node before it joins, so that a node with many edges is summed up on the map
    side, and writes these minima, so that both sides of the join are plain shuffles and a hot node's part can be split;
    every round is written to the shared folder. Rounds go on until the edges no longer change, which the alternation reaches
    after about the square of the logarithm of the nodes. Duplicate edges and loops change nothing; no edges, no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    while (seen := _signature(now)) != before and seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        large = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "large")
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        after = written(small, "edges")
        for old in (now, least, large, lower):
            dropped(old)
        now, before = after, seen
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
