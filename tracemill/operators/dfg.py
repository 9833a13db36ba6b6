"""Directly-follows graphs: ``(src, dst, weight)``, where a null src is a start, a null dst an end, both an empty trace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def steps(log: DataFrame, *keep: str) -> DataFrame:
    """Every step of every trace, from its start to its end; an empty trace is one step from nothing to nothing."""
    at = F.explode(F.sequence(F.lit(0), F.size("trace")))
    row = log.select(at.alias("_at"), "trace", *keep)
    return row.select(F.when(F.col("_at") > 0, F.get("trace", F.col("_at") - 1)).alias("src"), F.get("trace", F.col("_at")).alias("dst"), *keep)


def dfg(log: DataFrame, weight: str | None = None) -> DataFrame:
    """Weights count steps, or add up a column of the language, such as a count or a probability."""
    if weight:
        return steps(log, weight).groupBy("src", "dst").agg(F.sum(weight).alias("weight"))
    return steps(log).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def dfg_of_events(events: DataFrame, case: str, activity: str, order: list[str]) -> DataFrame:
    """The same from the event table without building traces: one window per case."""
    from pyspark.sql import Window as W

    w = W.partitionBy(case).orderBy(*order)
    rows = events.select(F.lag(activity).over(w).alias("_before"), F.col(activity).alias("_own"), F.lead(activity).over(w).alias("_after"))
    ends = F.when(F.col("_before").isNull(), F.struct(F.lit(None).cast("string").alias("src"), F.col("_own").alias("dst")))
    edges = F.array_compact(F.array(ends, F.struct(F.col("_own").alias("src"), F.col("_after").alias("dst"))))
    return rows.select(F.explode(edges).alias("e")).groupBy("e.src", "e.dst").agg(F.count("*").alias("weight"))


#: Most edges of a graph that is filtered: it goes to the driver once a round.
MOST_EDGES = 500_000


def dfg_with_fitness(log: DataFrame, fitness: float = 1.0) -> DataFrame:
    """Drops, again and again, the traces with an edge of least weight, while at least ``fitness`` of them would stay.

    Works on variants, cached with the keys of their edges. A round is one job: a filter by the edges removed so far and a
    sum per edge, which is small and goes to the driver; so the plan grows by a list of keys only.
    """
    if fitness >= 1:
        return dfg(log)
    key = lambda c: F.coalesce(F.hex(c), F.lit("-"))
    edge = lambda i: F.concat(key(F.when(i > 0, F.get("trace", i - 1))), F.lit(">"), key(F.get("trace", i)))
    variants = log.groupBy("trace").agg(F.count("*").alias("cnt"))
    base = variants.select("cnt", F.transform(F.sequence(F.lit(0), F.size("trace")), edge).alias("edges")).cache()
    removed: list[str] = []
    total, kept = None, {}
    while True:
        now = base.where(~F.arrays_overlap("edges", F.array(*map(F.lit, removed)))) if removed else base
        found = now.select(F.explode("edges").alias("e"), "cnt").groupBy("e").agg(F.sum("cnt").alias("w")).limit(MOST_EDGES + 1).collect()
        if len(found) > MOST_EDGES:
            raise ValueError(f"more than {MOST_EDGES} edges")
        weights = {r.e: r.w for r in found}
        traces = sum(w for e, w in weights.items() if e.startswith("->"))
        total = traces if total is None else total
        if traces < fitness * total:
            break
        kept = weights
        inner = {e: w for e, w in weights.items() if e != "->-"}
        if not inner:
            break
        removed += [e for e, w in inner.items() if w == min(inner.values())]
    base.unpersist()
    name = lambda h: None if h == "-" else bytes.fromhex(h).decode()
    rows = [(name(a), name(b), w) for e, w in kept.items() for a, _, b in [e.partition(">")]]
    return log.sparkSession.createDataFrame(rows, "src string, dst string, weight long")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("src", "dst", F.col("weight").alias("wa")), b.select(F.col("src").alias("s2"), F.col("dst").alias("d2"), F.col("weight").alias("wb"))
    return left.join(right, F.col("src").eqNullSafe(F.col("s2")) & F.col("dst").eqNullSafe(F.col("d2")), "full_outer")


def edge_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return both(a, b).agg(F.coalesce(F.sum(F.abs(F.coalesce("wa", zero) - F.coalesce("wb", zero))), zero).alias("difference"))


def edge_difference_no_frequency(a: DataFrame, b: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return both(a, b).agg(F.coalesce(F.sum(((F.coalesce("wa", zero) != 0) != (F.coalesce("wb", zero) != 0)).cast("long")), zero).alias("difference"))
