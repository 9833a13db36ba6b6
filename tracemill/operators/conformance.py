"""Conformance between two stochastic languages, each ``(trace, cnt, n)``: joins on the trace and one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def probed(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """(trace, pa, pb) for the traces of a; pb is 0 where b lacks the trace."""
    left = a.select("trace", (F.col("cnt") / F.col("n")).alias("pa"))
    right = b.select("trace", (F.col("cnt") / F.col("n")).alias("pb"))
    return left.join(right, "trace", how).withColumn("pb", F.coalesce("pb", F.lit(0.0)))


def unit_earth_movers(pairs: DataFrame) -> DataFrame:
    return pairs.agg((1 - F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("pa") - F.col("pb"))), F.lit(0.0))).alias("value"))


def hellinger(pairs: DataFrame) -> DataFrame:
    """Over the traces of the first language only, so not symmetric."""
    return pairs.agg((1 - F.sqrt(F.coalesce(F.sum(F.pow(F.sqrt("pb") - F.sqrt("pa"), 2)), F.lit(0.0)) / 2)).alias("value"))


def chi_squared(pairs: DataFrame) -> DataFrame:
    """Over the traces of the first language only, so not symmetric."""
    return pairs.agg((1 - F.coalesce(F.sum(F.pow(F.col("pa") - F.col("pb"), 2) / (F.col("pa") + F.col("pb"))), F.lit(0.0)) / 2).alias("value"))


def jensen_shannon(pairs: DataFrame) -> DataFrame:
    s = F.col("pa") + F.col("pb")
    term = F.col("pa") * F.log2("pa") + F.col("pb") * F.log2("pb") - s * F.log2(s) + s
    both = pairs.where("pa > 0 and pb > 0").agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(n) for x, n in ((term, "t"), (F.col("pa"), "sa"), (F.col("pb"), "sb"))])
    return both.select((1 - F.sqrt(F.greatest(F.lit(0.0), (F.col("t") + 1 - F.col("sa") + 1 - F.col("sb")) / 2))).alias("value"))


def entropic_relevance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits per trace of a when coded with b; traces that b lacks cost their length in the alphabet of a and its end."""
    return relevance_of(probed(a, b), a)


def relevance_of(pairs: DataFrame, a: DataFrame) -> DataFrame:
    size = a.select(F.explode("trace").alias("x")).agg(F.countDistinct("x").alias("k"))
    known = F.col("pb") > 0
    cost = F.col("pa") * F.when(known, -F.log2("pb")).otherwise((F.size("trace") + 1) * F.log2(1 + F.col("k")))
    total = pairs.join(F.broadcast(size)).agg(F.sum(cost).alias("j"), F.least(F.lit(1.0), F.coalesce(F.sum(F.when(known, F.col("pa"))), F.lit(0.0))).alias("rho"))
    h = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    return total.select((F.coalesce("j", F.lit(0.0)) + h(F.col("rho")) + h(1 - F.col("rho"))).alias("value"))


def gain(pairs: DataFrame, share: float = 0.0) -> DataFrame:
    """(numerator, entropy) of the gain measures: common information per trace over the first language's own."""
    h = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(0.0)
    split = lambda x: h(x * (1 - share)) + h(x * share) if share else h(x)
    return pairs.agg(F.coalesce(F.sum(F.when(F.col("pb") > 0, F.least(split(F.col("pa")), split(F.col("pb"))))), F.lit(0.0)).alias("common"), F.coalesce(F.sum(split(F.col("pa"))), F.lit(0.0)).alias("own"))


def gain_recall(pairs: DataFrame, share: float = 0.0) -> DataFrame:
    return gain(pairs, share).select(F.when(F.col("own") > 0, F.col("common") / F.col("own")).otherwise(1.0).alias("value"))


def gain_precision(pairs: DataFrame, model_entropy: float, share: float = 0.0) -> DataFrame:
    """The model's own entropy is computed on the model; see models.markov."""
    return gain(pairs, share).select((F.when(F.lit(model_entropy) > 0, F.col("common") / F.lit(model_entropy)).otherwise(1.0)).alias("value"))


def kgrams(slang: DataFrame, k: int, start: str = "+", end: str = "-") -> DataFrame:
    """(trace, cnt, n): the stochastic language of k-grams of the traces with a start and an end mark; a trace shorter than
    a k-gram counts once as a whole."""
    marked = slang.select(F.concat(F.array(F.lit(start)), "trace", F.array(F.lit(end))).alias("t"), "cnt")
    grams = F.when(F.size("t") <= k, F.array(F.col("t"))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - k + 1, F.lit(1))), lambda i: F.slice("t", i, F.lit(k))))
    counts = marked.select(F.explode(grams).alias("trace"), "cnt").groupBy("trace").agg(F.sum("cnt").alias("cnt"))
    return counts.join(F.broadcast(counts.agg(F.sum("cnt").alias("n"))))


MEASURES = {"uemsc": unit_earth_movers, "hsc": hellinger, "cssc": chi_squared}


def markovian(a: DataFrame, b: DataFrame, k: int, measure: str = "uemsc") -> DataFrame:
    return MEASURES[measure](probed(kgrams(a, k), kgrams(b, k)))
