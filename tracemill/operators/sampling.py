"""Samples and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .log import joined


#: Hexadecimal digits of a key's MD5 that name its bucket: 4,096 of them.
BUCKET_DIGITS = 3


def bucket(key: Column) -> Column:
    return F.substring(F.md5(key), 1, BUCKET_DIGITS)


def ranked(rows: DataFrame, group: str, key: Column) -> DataFrame:
    """Adds ``rank``, from 0 within each group, in the order of hash buckets and of the key within one: no group is ever
    sorted in one task. The offsets are a running sum over the buckets of a group. Any SQL engine can repeat the order."""
    own = rows.withColumn("_b", bucket(key))
    sizes = own.groupBy(group, "_b").agg(F.count("*").alias("_k"))
    base = sizes.select(group, "_b", (F.sum("_k").over(W.partitionBy(group).orderBy("_b")) - F.col("_k")).alias("_base"))
    at = F.row_number().over(W.partitionBy(group, "_b").orderBy(key)) - 1
    return own.withColumn("_at", at).join(base, [group, "_b"]).withColumn("rank", F.col("_base") + F.col("_at")).drop("_b", "_at", "_base")


def picked(rows: DataFrame, draws: DataFrame, key: Column) -> DataFrame:
    """For each of ``draws(..., u)``, u from 0 below 1, one of ``rows(..., cnt)``, as often as its share of all counts.

    Draws meet the running sum of counts through a range join. The sum runs over the distinct counts: about the square root
    of twice their total at most, so that side may be broadcast.
    """
    per = rows.groupBy("cnt").agg(F.count("*").alias("_k"))
    total = per.agg(F.sum(F.col("cnt") * F.col("_k")).alias("_n"))
    w = W.partitionBy("_n").orderBy("cnt").rowsBetween(W.unboundedPreceding, -1)
    levels = per.join(F.broadcast(total)).withColumn("_from", F.coalesce(F.sum(F.col("cnt") * F.col("_k")).over(w), F.lit(0))).drop("_n")
    at = draws.join(F.broadcast(total)).withColumn("_at", F.floor(F.col("u") * F.col("_n"))).drop("u", "_n")
    level = at.join(F.broadcast(levels), F.expr("_at >= _from and _at < _from + cnt * _k")).withColumn("rank", F.expr("(_at - _from) div cnt")).drop("_at", "_from", "_k")
    return level.join(ranked(rows, "cnt", key), ["cnt", "rank"]).drop("rank")


def arithmetic_draws(spark: SparkSession, k: int, b: int = 11, a: int = 1103515245, m: int = 2147483647) -> DataFrame:
    """k numbers u from 0 below 1 by arithmetic, which any SQL engine can repeat: multiples of a, from b on, modulo m."""
    return spark.range(k).select(((F.col("id") * a + b) % m / F.lit(float(m))).alias("u"))


def sample_traces(slang: DataFrame, k: int, seed: int = 0, draws: DataFrame | None = None) -> DataFrame:
    """k traces with replacement, each as likely as its probability: (trace, cnt, n). ``draws(u)`` replaces random ones."""
    draws = slang.sparkSession.range(k).select(F.rand(seed).alias("u")) if draws is None else draws
    found = picked(slang.select("trace", "cnt"), draws, joined())
    return found.groupBy("trace").agg(F.count("*").alias("cnt")).withColumn("n", F.lit(k).cast("long"))


def folds(log: DataFrame, n: int, fold: int, seed: int = 0, key: str = "case_id") -> DataFrame:
    """The cases whose hash falls into one fold: the same whatever the partitions or their order."""
    return log.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)) == fold)


def folds_arithmetic(log: DataFrame, n: int, fold: int, key: str, a: int = 48271, b: int = 11, m: int = 2147483647) -> DataFrame:
    """The same by arithmetic on a whole-numbered case id, which any SQL engine can repeat."""
    return log.where(((F.col(key) * a + b) % m) % n == fold)
