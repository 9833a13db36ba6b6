"""Trace filters. All of them remove the traces that match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "=": Column.__eq__, "<>": Column.__ne__}


def remove_length(log: DataFrame, comparison: str, k: int) -> DataFrame:
    return log.where(~COMPARISONS[comparison](F.size("trace"), F.lit(k)))


def remove_empty(log: DataFrame) -> DataFrame:
    return log.where(F.size("trace") > 0)


def matches(selector: str, activity: str) -> Column:
    """``all`` and ``none`` hold for an empty trace, ``any``, ``start`` and ``end`` don't."""
    is_it = lambda a: a == activity
    return {
        "any": F.exists("trace", is_it),
        "all": F.forall("trace", is_it),
        "none": ~F.exists("trace", is_it),
        "start": F.coalesce(F.get("trace", F.lit(0)) == activity, F.lit(False)),
        "end": F.coalesce(F.get("trace", F.size("trace") - 1) == activity, F.lit(False)),
    }[selector]


def remove_activity(log: DataFrame, selector: str, activity: str) -> DataFrame:
    return log.where(~matches(selector, activity))


def retain(log: DataFrame, keep: Column) -> DataFrame:
    return log.where(keep)


def remove_edges(log: DataFrame, edges: DataFrame) -> DataFrame:
    """Removes the traces with one of the directly-follows ``edges(src, dst)``; a null end marks a start or an end."""
    from .dfg import steps

    wanted = edges.select(F.struct("src", "dst").alias("_edge"))
    bad = steps(log, "case_id").select("case_id", F.struct("src", "dst").alias("_edge")).join(wanted, "_edge", "left_semi").select("case_id").distinct()
    return log.join(bad, "case_id", "left_anti")
