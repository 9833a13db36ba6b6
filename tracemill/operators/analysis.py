"""Measures of one log or stochastic language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .distance import encoded, normalised, pairs
from .log import joined, p
from .sampling import ranked


def by_likelihood() -> list[Column]:
    return [F.col("cnt").desc(), joined().asc()]


def completeness(log: DataFrame) -> DataFrame:
    """Chao's estimate: variants seen over variants estimated."""
    counts = log.groupBy("trace").count()
    one = counts.agg(F.count("*").alias("s"), F.coalesce(F.sum((F.col("count") == 1).cast("long")), F.lit(0)).alias("f1"), F.coalesce(F.sum((F.col("count") == 2).cast("long")), F.lit(0)).alias("f2"))
    more = F.when(F.col("f2") > 0, F.col("f1") * F.col("f1") / (2 * F.col("f2"))).otherwise(F.col("f1") * (F.col("f1") - 1) / 2)
    return one.select(F.when(F.col("s") + more > 0, F.col("s") / (F.col("s") + more)).otherwise(0.0).alias("completeness"))


def minimum_probability(slang: DataFrame, q: float) -> DataFrame:
    return slang.where(p() >= q)


def most_likely(slang: DataFrame, k: int) -> DataFrame:
    return slang.orderBy(*by_likelihood()).limit(k)


def mode(slang: DataFrame) -> DataFrame:
    return most_likely(slang, 1)


def coverage(slang: DataFrame, q: float) -> DataFrame:
    """The likeliest traces until their probabilities add up to q; of equally likely ones those first by :func:`ranked`.

    Counts of equal size are summed first: the running sum goes over the distinct counts, of which there are at most
    about the square root of twice the number of cases, and ranks are needed only among the variants of the last count.
    """
    per = slang.groupBy("cnt", "n").agg(F.count("*").alias("k"))
    w = W.partitionBy("n").orderBy(F.col("cnt").desc()).rowsBetween(W.unboundedPreceding, -1)
    before = per.withColumn("before", F.coalesce(F.sum(F.col("cnt") * F.col("k")).over(w), F.lit(0))).where(F.col("before") < q * F.col("n"))
    full = (F.col("before") + F.col("cnt") * F.col("k") <= q * F.col("n")).alias("full")
    need = before.select("cnt", full, F.ceil((q * F.col("n") - F.col("before")) / F.col("cnt")).alias("need"))
    rows = slang.join(F.broadcast(need), "cnt")
    part = ranked(rows.where("not full"), "cnt", joined()).where("rank < need")
    return rows.where("full").select(*slang.columns).unionByName(part.select(*slang.columns))


def entropy(slang: DataFrame) -> DataFrame:
    return slang.agg(F.coalesce(F.sum(-p() * F.log2(p())), F.lit(0.0)).alias("entropy"))


def variety(slang: DataFrame) -> DataFrame:
    """Sum over unordered pairs of variants of edit distance times both probabilities."""
    (coded,) = encoded(slang)
    d = F.levenshtein("a_code", "b_code").cast("long") * F.col("a_cnt") * F.col("b_cnt")
    total = pairs(coded.select("code", "cnt", "n")).agg(F.sum(d).alias("s"), F.max("a_n").alias("n"))
    return total.select(F.coalesce(F.col("s") / F.col("n") / F.col("n"), F.lit(0.0)).alias("variety"))


def distance_sums(slang: DataFrame, weighted: bool = True) -> DataFrame:
    """(trace, distance): summed normalised distance to all variants, each by its probability or once."""
    (coded,) = encoded(slang)
    w = (lambda s: F.col(f"{s}_cnt") / F.col(f"{s}_n")) if weighted else (lambda s: F.lit(1.0))
    d = normalised("a_code", "b_code")
    both = F.array(F.struct(F.col("a_code").alias("code"), (d * w("b")).alias("d")), F.struct(F.col("b_code").alias("code"), (d * w("a")).alias("d")))
    sums = pairs(coded.select("code", "cnt", "n")).select(F.explode(both).alias("x")).groupBy("x.code").agg(F.sum("x.d").alias("d"))
    return coded.join(sums, "code", "left").select("trace", F.coalesce("d", F.lit(0.0)).alias("distance"))


def medoid(slang: DataFrame, k: int = 1, weighted: bool = True) -> DataFrame:
    """The k traces nearest to all; ties go by the trace."""
    return distance_sums(slang, weighted).orderBy(F.round("distance", 9), joined()).limit(k)


def timestamps_ordered(events: DataFrame, case: str, ts: str, position: list[str]) -> DataFrame:
    """Whether the known timestamps of every case never decrease in the order of its events."""
    w = W.partitionBy(case).orderBy(*position).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(ts, ignorenulls=True).over(w)
    return events.select((F.col(ts).isNull() | last.isNull() | (F.col(ts) >= last)).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ordered"))
