"""Event tables to logs, languages and stochastic languages.

A log is ``(case_id, trace ARRAY<STRING>)``, a stochastic language ``(trace, cnt, n)`` with ``p = cnt / n``: the counts stay
whole numbers, and one division comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str, ts: str, order: list[str], gap: str = "6 hours") -> DataFrame:
    """The events with ``case_id``: a user's events, cut where more than ``gap`` lies between two of them."""
    w = W.partitionBy(user).orderBy(ts, *order)
    starts = F.coalesce(F.col(ts) - F.lag(ts).over(w) > F.expr(f"INTERVAL {gap}"), F.lit(True))
    return events.withColumn("_starts", starts.cast("long")).withColumn("_session", F.sum("_starts").over(w)).withColumn("case_id", F.concat_ws("-", F.col(user).cast("string"), F.col("_session").cast("string"))).drop("_starts", "_session")


def to_log(events: DataFrame, case: str | Column, activity: str, order: list[str]) -> DataFrame:
    """(case_id, trace); one shuffle on the case, order restored inside each."""
    key = F.col(case) if isinstance(case, str) else case
    rows = events.groupBy(key.alias("case_id")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(activity).alias("_activity")))).alias("_events"))
    return rows.select("case_id", F.col("_events._activity").alias("trace"))


def slang(log: DataFrame) -> DataFrame:
    """Trace variants with their counts and the number of cases."""
    return with_total(log.groupBy("trace").agg(F.count("*").alias("cnt")))


def with_total(counts: DataFrame, of: str = "cnt") -> DataFrame:
    """Adds the total ``n`` by joining the one row that holds it."""
    return counts.join(F.broadcast(counts.agg(F.sum(of).alias("n"))))


def lang(log: DataFrame) -> DataFrame:
    return log.select("trace").distinct()


def p() -> Column:
    return F.col("cnt") / F.col("n")


def joined(trace: str | Column = "trace") -> Column:
    return F.concat_ws(",", trace)


def activities(log: DataFrame) -> DataFrame:
    return log.select(F.explode("trace").alias("activity")).distinct()


def prefixes(language: DataFrame, *keep: str) -> DataFrame:
    """(prefix, next, *keep): every proper prefix with the activity after it; next is null at the end of a trace."""
    at = F.explode(F.sequence(F.lit(0), F.size("trace")))
    return language.select(at.alias("_at"), "trace", *keep).select(F.slice("trace", F.lit(1), F.col("_at")).alias("prefix"), F.get("trace", F.col("_at")).alias("next"), *keep)
