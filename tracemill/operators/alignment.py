"""Alignments, executions and what is measured on them.

The model is broadcast, and searches run per distinct trace, never per case: ``slang`` rows in, one row each out. Moves are
``array<struct<kind, label, transition>>`` with kinds synchronous, log, model and silent.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..models import kernels
from ..models.markov import trace_probability
from ..models.semantics import Indexed, Net, Semantics

MOVES = "array<struct<kind: string, label: string, transition: int>>"
#: Largest pickled model, in bytes, that is broadcast; larger ones have no finite search anyway.
MODEL_BYTES = 64 << 20


def shared(df: DataFrame, model: Semantics):
    model = Indexed(model) if isinstance(model, Net) else model
    if len(pickle.dumps(model)) > MODEL_BYTES:
        raise ValueError("the model is too large to be shared with the tasks")
    return df.sparkSession.sparkContext.broadcast(model)


def per_row(df: DataFrame, column: str, name: str, kind: str, f: Callable) -> DataFrame:
    """Adds a column by a kernel over one column. Rows are first dealt to a fixed number of partitions, as kernels cost far
    more than their rows weigh."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([f(x) for x in b.column(column).to_pylist()], type=arrow.field(name).type)
            yield pa.RecordBatch.from_arrays([*b.columns, made], schema=arrow)

    return df.repartition(parts, column).mapInArrow(run, schema)


def align(slang: DataFrame, model: Semantics) -> DataFrame:
    """The variants with ``moves``: a cheapest alignment each."""
    m = shared(slang, model)
    return per_row(slang, "trace", "moves", MOVES, lambda t: [{"kind": k, "label": a, "transition": i} for k, a, i in kernels.align(m.value, t)])


def explain(slang: DataFrame, model: Semantics) -> DataFrame:
    m = shared(slang, model)
    return per_row(slang, "trace", "moves", MOVES, lambda t: [{"kind": k, "label": a, "transition": i} for k, a, i in kernels.explain(m.value, t)])


def probabilities(language: DataFrame, model: Semantics) -> DataFrame:
    """The traces with ``pb``, the model's probability of each, rounded once to a double."""
    m = shared(language, model)
    return per_row(language, "trace", "pb", "double", lambda t: float(trace_probability(m.value, t)))


def probed(slang: DataFrame, model: Semantics) -> DataFrame:
    """(trace, pa, pb), as conformance.probed has it, against a model."""
    return probabilities(slang, model).select("trace", (F.col("cnt") / F.col("n")).alias("pa"), "pb")


def _count(*kinds: str) -> Column:
    return F.size(F.filter("moves", lambda m: m["kind"].isin(*kinds)))


def trace_fitness(alignments: DataFrame) -> DataFrame:
    """Expected share of synchronous moves; silent moves don't count, and an alignment of nothing else counts as 1."""
    counted = _count("synchronous", "log", "model")
    each = F.when(counted == 0, 1.0).otherwise(_count("synchronous") / counted)
    return alignments.agg(F.sum(F.col("cnt") / F.col("n") * each).alias("fitness"))


def fitting_traces(alignments: DataFrame) -> DataFrame:
    fits = _count("log", "model") == 0
    return alignments.agg((F.sum(F.when(fits, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("fitting"))


def enabled_after(model: Semantics, path: list[int]) -> int:
    state = model.initial()
    for t in path:
        if t not in model.enabled(state):
            raise ValueError(f"transition {t} is not enabled")
        state = model.fire(state, t)
    return len(model.enabled(state))


def escaping_edges_precision(alignments: DataFrame, model: Semantics) -> DataFrame:
    """Edges taken over edges enabled, over the prefixes of the fired transitions, weighted by probability."""
    m = shared(alignments, model)
    path = F.transform(F.filter("moves", lambda x: x["kind"] != "log"), lambda x: x["transition"])
    at = alignments.select(path.alias("path"), "cnt").select("path", "cnt", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("i"))
    prefix = at.select(F.slice("path", F.lit(1), F.col("i")).alias("prefix"), F.get("path", F.col("i")).alias("next"), "cnt")
    edges = prefix.groupBy("prefix", "next").agg(F.sum("cnt").alias("cnt"))
    nodes = edges.groupBy("prefix").agg(F.sum("cnt").alias("cnt"), F.count("next").alias("taken"))
    nodes = per_row(nodes, "prefix", "enabled", "long", lambda p: enabled_after(m.value, p)).where("enabled > 0")
    return nodes.agg((F.sum(F.col("cnt") * F.col("taken")) / F.sum(F.col("cnt") * F.col("enabled"))).alias("precision"))


EXECUTION = "array<struct<move_index: int, activity: string, also_in_log: boolean, fired_transition: int, other_enabled_transitions: array<int>, move_index_of_enablement: int, event_index: int>>"


def executed(model: Semantics, moves: list[kernels.Move]) -> list[dict]:
    """One record per move that fires a transition. A transition's enabling move is the last one after which it was enabled
    without having been so right before; None if it has been enabled from the start."""
    state, out, event = model.initial(), [], 0
    since: dict[int, int | None] = dict.fromkeys(model.enabled(state))
    for i, (kind, label, t) in enumerate(moves):
        at = event if kind in ("log", "synchronous") else None
        event += at is not None
        if kind == "log":
            continue
        on = model.enabled(state)
        out.append({"move_index": i, "activity": label, "also_in_log": kind == "synchronous", "fired_transition": t, "other_enabled_transitions": [x for x in on if x != t], "move_index_of_enablement": since.get(t), "event_index": at})
        state = model.fire(state, t)
        since = {x: since[x] if x in since and x != t else i for x in model.enabled(state)}
    return out


def executions(events: DataFrame, model: Semantics) -> DataFrame:
    """One row per fired transition of every case of ``events(case_id, pos, activity, ts, resource)``, in global order.

    Traces are aligned once per variant, and joined with their cases' times and resources. The order: by the last known time
    of the case up to the move, then by case and move; so rows without a time stay with the one before them.
    """
    m = shared(events, model)
    own = events.where("pos is not null").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", "activity", "ts", "resource"))).alias("e"))
    cases = own.select("case_id", F.col("e.activity").alias("trace"), F.col("e.ts").alias("ts"), F.col("e.resource").alias("resource"))
    aligned = per_row(cases.select("trace").distinct(), "trace", "x", EXECUTION, lambda t: executed(m.value, kernels.align(m.value, t)))
    rows = cases.join(aligned, "trace").select("case_id", "ts", "resource", F.explode("x").alias("x"))
    at = lambda c: F.get(c, F.col("x.event_index"))
    rows = rows.select("case_id", "x.move_index", "x.activity", "x.also_in_log", "x.fired_transition", "x.other_enabled_transitions", "x.move_index_of_enablement", at("ts").alias("time_of_execution"), at("resource").alias("resource"))
    last = F.last("time_of_execution", ignorenulls=True).over(W.partitionBy("case_id").orderBy("move_index"))
    return rows.withColumn("order_time", last)


def with_utilisation(rows: DataFrame, bucket: str = "day") -> DataFrame:
    """Adds the share of the resources able to fire a transition that were occupied when the execution started.

    An execution starts when both the move that enabled it and the last execution of its resource are over, and occupies
    its resource from then until it is over; those that start with the log have 0. As a resource's intervals don't overlap,
    those occupied are the starts before less the ends up to then, of resources able to do the same: a running sum per
    transition, within buckets of time and over the buckets' totals, so that no transition is sorted in one task.
    """
    begin = F.to_timestamp(F.lit("0001-01-01"))
    numbered = rows.withColumn("time", F.coalesce("order_time", begin))
    before = numbered.select("case_id", F.col("move_index").alias("move_index_of_enablement"), F.col("time").alias("enabled_at"))
    used = F.lag("time").over(W.partitionBy("resource").orderBy("time", "case_id", "move_index"))
    own = numbered.join(before, ["case_id", "move_index_of_enablement"], "left").withColumn("used_at", F.when(F.col("resource").isNotNull(), used))
    own = own.withColumn("start", F.greatest("enabled_at", "used_at"))
    held = own.where("resource is not null")
    able = held.select(F.col("fired_transition").alias("can"), "resource").distinct()
    sizes = able.groupBy(F.col("can").alias("fired_transition")).agg(F.count("*").alias("able"))
    # at equal times: ends, then what is asked, then starts
    busy = held.where("start is null or start < time").join(able, "resource")
    busy = busy.select("can", F.explode(F.array(F.struct(F.coalesce("start", begin).alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("time").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step")))).alias("x")).select("can", "x.*", F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("int").alias("move_index"))
    asks = held.where("start is not null").select(F.col("fired_transition").alias("can"), F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("step"), F.col("case_id").cast("string").alias("case_id"), F.col("move_index").cast("int").alias("move_index"))
    line = busy.unionByName(asks).withColumn("bucket", F.date_trunc(bucket, "at"))
    inside = F.sum("step").over(W.partitionBy("can", "bucket").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    totals = line.groupBy("can", "bucket").agg(F.sum("step").alias("total"))
    base = totals.select("can", "bucket", (F.sum("total").over(W.partitionBy("can").orderBy("bucket")) - F.col("total")).alias("base"))
    hits = line.withColumn("inside", inside).where("kind = 1").join(base, ["can", "bucket"]).select(F.col("case_id").alias("_case"), F.col("move_index").alias("_move"), (F.col("base") + F.col("inside")).alias("occupied"))
    out = own.join(hits, (F.col("case_id").cast("string") == F.col("_case")) & (F.col("move_index") == F.col("_move")), "left").join(sizes, "fired_transition", "left")
    share = F.when(F.col("resource").isNull(), None).when(F.col("start").isNull(), 0.0).otherwise(F.coalesce("occupied", F.lit(0)) / F.col("able"))
    return out.select(*rows.columns, share.alias("resource_utilisation"))


def executions_ordered(rows: DataFrame) -> DataFrame:
    """Whether the known times of the whole list, in the order given by order_time, case and move, never decrease."""
    return rows.where("time_of_execution is not null").agg(F.coalesce(F.bool_and(F.col("time_of_execution") >= F.col("order_time")), F.lit(True)).alias("ordered"))


def weights(alignments: DataFrame) -> DataFrame:
    """(transition, weight): expected firings of each transition."""
    each = alignments.select(F.explode(F.filter("moves", lambda m: m["kind"] != "log")).alias("m"), "cnt", "n")
    return each.groupBy(F.col("m.transition").alias("transition")).agg((F.sum("cnt") / F.max("n")).alias("weight"))


