"""Probabilities that a stochastic language gives to traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import p


def of_log(slang: DataFrame, language: DataFrame) -> DataFrame:
    """Summed probability of a set of traces."""
    hit = slang.join(language.select("trace").distinct(), "trace", "left_semi")
    return hit.agg(F.coalesce(F.sum("cnt") / F.max("n"), F.lit(0.0)).alias("probability"))


def of_trace(slang: DataFrame, trace: list[str]) -> DataFrame:
    wanted = F.array(*[F.lit(a) for a in trace]) if trace else F.array().cast("array<string>")
    return slang.where(F.col("trace") == wanted).agg(F.coalesce(F.max(p()), F.lit(0.0)).alias("probability"))
