"""Queries that write an object of the driver's tables to a file of each format, read it back and use what was read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from fractions import Fraction
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import discovery as D
from ..models import objects as O
from ..models.tree import TAU, activity, node
from ..operators import alignment, log
from ..sources import formats, logs
from .catalogue import as_text, events, query, session_events, session_log, session_slang
from .models import SUBSET, _FITS, flower, language, rounded, told

#: One of two first steps, two steps in any order, a last step that may be left out.
SMALL_TREE = node("sequence", [node("xor", [activity("view"), activity("signup")]), node("concurrent", [activity("click"), activity("purchase")]), node("xor", [activity("error"), TAU])])
SMALL_TRACES = [f"{first},{middle}{last}" for first in ("view", "signup") for middle in ("click,purchase", "purchase,click") for last in (",error", "")]
_IN_SMALL = ", ".join(f"'{t}'" for t in SMALL_TRACES)


def through(thing: object, name: str) -> object:
    """What a file of the format holds after ``thing`` was written to it."""
    with tempfile.TemporaryDirectory() as folder:
        path = f"{folder}/x.{name}"
        formats.write(thing, path, name)
        return formats.read(path, name)


def words(name: str, sql: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    query(sql, f"file_{name}")(f)


words("lang", "SELECT DISTINCT trace FROM log", lambda s, d: told(s, [(",".join(t),) for t in through(set(language(s, d)), "lang")], "trace string"))
words("slang", "SELECT trace, round(cnt / n, 6) AS p FROM slang", lambda s, d: told(s, [(",".join(t), round(float(p), 6)) for t, p in through(language(s, d), "slang").items()], "trace string, p double"))


@query("SELECT trace, greatest(len(acts) - 1, 0)::BIGINT AS links, round(cnt / n, 6) AS p FROM slang", "file_spolang")
def file_spolang(spark, d):
    orders = [O.Order([(a, (i - 1,) if i else ()) for i, a in enumerate(t)], p) for t, p in language(spark, d).items()]
    rows = [(",".join(a for a, _ in o.events), sum(len(b) for _, b in o.events), round(float(o.probability), 6)) for o in through(orders, "spolang")]
    return told(spark, rows, "trace string, links long, p double")


_EDGES = "SELECT src, dst, round(sum(cnt / n), 6) AS weight FROM (SELECT cnt, n, unnest(list_concat([NULL], acts)) AS src, unnest(list_concat(acts, [NULL])) AS dst FROM slang) GROUP BY src, dst"


def edges(spark, graph: O.FollowsGraph) -> DataFrame:
    rows = [(a, b, round(float(w), 6)) for (a, b), w in graph.edges.items()] + [(None, a, round(float(w), 6)) for a, w in graph.starts.items()] + [(a, None, round(float(w), 6)) for a, w in graph.ends.items()]
    return told(spark, rows, "src string, dst string, weight double")


for _name in ("dfg", "sdfm"):
    words(_name, _EDGES, lambda s, d, n=_name: edges(s, through(O.graph_of_language(language(s, d)), n)))
words("dfm", "SELECT src, dst FROM dfg", lambda s, d: edges(s, through(O.graph_of_language(language(s, d)), "dfm")).select("src", "dst"))


def likely(spark, d, model) -> DataFrame:
    return alignment.probabilities(session_slang(spark, d, 0), O.as_model(model)).select(as_text(), F.round("pb", 6).alias("probability"))


for _name in ("sdfa", "snfa", "slpn"):
    words(_name, "SELECT a.trace, round(coalesce(b.cnt / b.n, 0), 6) AS probability FROM a LEFT JOIN b USING (trace)", lambda s, d, n=_name: likely(s, d, through(O.automaton_of_language(language(s, d, 1)), n)))


def member(spark, d, model, parity: int | None = 0) -> DataFrame:
    return alignment.probabilities(session_slang(spark, d, parity), O.as_model(model)).select(as_text(), (F.col("pb") > 0).alias("fits"))


for _name in ("dfa", "lpn", "pnml"):
    words(_name, "SELECT trace, trace IN (SELECT trace FROM b) AS fits FROM a", lambda s, d, n=_name: member(s, d, through(D.prefix_automaton(set(language(s, d, 1))), n)))
words("lola", f"SELECT trace, {_FITS} = len(acts) AS fits FROM slang", lambda s, d: fitting(s, d, through(flower(*SUBSET), "lola")))


def fitting(spark, d, model) -> DataFrame:
    """The format has no silent steps and no end, so traces are replayed: what can be fired to the last event fits."""

    def fired(trace: list[str]) -> bool:
        state = model.initial()
        for a in trace:
            t = next((t for t in model.enabled(state) if model.label(t) == a), None)
            if t is None:
                return False
            state = model.fire(state, t)
        return True

    return alignment.per_row(session_slang(spark, d).select("trace"), "trace", "fits", "boolean", fired).select(as_text(), "fits")


for _name, _thing in (("ptree", SMALL_TREE), ("ptml", SMALL_TREE), ("bpmn", O.diagram_of_tree(SMALL_TREE))):
    words(_name, f"SELECT trace, trace IN ({_IN_SMALL}) AS fits FROM slang", lambda s, d, n=_name, x=_thing: member(s, d, through(x, n), None))
for _name, _thing in (("sptree", D.uniform(SMALL_TREE)), ("sbpmn", D.uniform(O.diagram_of_tree(SMALL_TREE)))):
    words(_name, f"SELECT trace, CASE WHEN trace IN ({_IN_SMALL}) THEN 0.125 ELSE 0.0 END AS probability FROM slang", lambda s, d, n=_name, x=_thing: alignment.probabilities(session_slang(s, d), O.as_model(through(x, n))).select(as_text(), F.round("pb", 6).alias("probability")))

#: A first step, then two in any order of which one may be left out.
SMALL_POWL = O.Powl("partial_order", children=[O.Powl("activity", "view"), O.Powl("activity", "click"), O.Powl("activity", "purchase", skippable=True)], edges=[(0, 1), (0, 2)])
words("powl", "SELECT trace, trace IN ('view,click', 'view,click,purchase', 'view,purchase,click') AS fits FROM slang", lambda s, d: member(s, d, through(SMALL_POWL, "powl"), None))


def aligned(spark, d) -> list[O.Alignment]:
    rows = alignment.align(session_slang(spark, d), flower(*SUBSET)).collect()  # one row per variant
    return [O.Alignment([(m.kind, m.label, m.transition) for m in r.moves], Fraction(r.cnt, r.n)) for r in rows]


def fitness(spark, found: list[O.Alignment]) -> DataFrame:
    total = float(sum(x.weight for x in found))
    rows = [([{"kind": k, "label": a, "transition": t} for k, a, t in x.moves], float(x.weight), total) for x in found]
    return rounded(alignment.trace_fitness(told(spark, rows, "moves array<struct<kind: string, label: string, transition: int>>, cnt double, n double")), "fitness")


_EACH = f"CASE WHEN len(acts) = 0 THEN 1 ELSE {_FITS} / len(acts) END"
words("ali", f"SELECT round(avg({_EACH}), 6) AS fitness FROM slang", lambda s, d: fitness(s, through(aligned(s, d), "ali")))
words("sali", f"SELECT round(sum(cnt / n * {_EACH}), 6) AS fitness FROM slang", lambda s, d: fitness(s, through(aligned(s, d), "sali")))


def through_executions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file of executions per batch, written and read by the task that has it."""
    for b in batches:
        held = through(b.to_pylist(), "exs")
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], type=pa.string()) for k in ("case_id", "activity")], names=["case_id", "activity"])


@query("SELECT acts[i] AS activity, count(*) AS fired, count(DISTINCT case_id) AS cases FROM (SELECT case_id, acts, unnest(range(1, len(acts) + 1)) AS i FROM log) GROUP BY 1", "file_exs")
def file_exs(spark, d):
    rows = session_events(spark, d).select("case_id", F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("activity"), "ts", F.lit(None).cast("string").alias("resource"))
    found = alignment.executions(rows, flower("click", "error", "purchase", "signup", "view")).where("activity is not null")
    held = found.select("case_id", "activity", "move_index", "fired_transition").mapInArrow(through_executions, "case_id string, activity string")
    return held.groupBy("activity").agg(F.count("*").alias("fired"), F.countDistinct("case_id").alias("cases"))


for _name, _pattern in (("svg", r"<text[^>]*>([a-z]+)</text>"), ("dot", r'^"[^"]+" \[label="([a-z]+)", shape=box\]')):

    def _drawn(spark, d, name=_name, pattern=_pattern):
        with tempfile.TemporaryDirectory() as folder:
            formats.write(O.graph_of_language(language(spark, d)), f"{folder}/x.{name}")
            found = set(re.findall(pattern, Path(f"{folder}/x.{name}").read_text(), re.M))
        return told(spark, [(a,) for a in sorted(found)], "activity string")

    query("SELECT DISTINCT event_type AS activity FROM events", f"file_{_name}")(_drawn)


# --- logs: written and read by Spark ---
def whole(spark, d) -> DataFrame:
    """The sessions as events with times, resources and attributes."""
    rows = session_events(spark, d).join(events(spark, d).select("event_id", "value"), "event_id")
    each = F.map_from_arrays(F.array(F.lit("value")), F.array(F.round("value", 2).cast("string")))
    return rows.select("case_id", F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("r"), F.col("event_id") % 7).alias("resource"), each.alias("attributes"), F.map_from_arrays(F.array(F.lit("user")), F.array(F.split_part("case_id", F.lit("-"), F.lit(1)))).alias("case_attributes"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all machines see: below the cluster's shared one, or a local one in local mode only."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
    made = f"{shared}/files-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tracemill-files-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def seen(rows: DataFrame) -> DataFrame:
    """Per activity, what a log's events say: their number, first and last time, resources."""
    return rows.where("activity is not null").groupBy("activity").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.countDistinct("resource").alias("resources"), F.round(F.sum(F.element_at("attributes", F.lit("value")).cast("double")), 2).alias("value"))


_SEEN = "SELECT event_type AS activity, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT event_id % 7) AS resources, round(sum(round(value, 2)), 2) AS value FROM events GROUP BY 1"
_VARIANTS = "SELECT trace, cnt FROM slang"
LOGS = {
    "xes": (lambda rows, path: logs.write_xes(rows, path), lambda spark, path: logs.read_xes(spark, path)),
    "xes_gz": (lambda rows, path: logs.write_xes(rows, path, compression="gzip"), lambda spark, path: logs.read_xes(spark, path)),
    "csv": (lambda rows, path: logs.write_csv(rows, path, ["value"]), lambda spark, path: logs.read_csv(spark, path)),
    "ocel": (lambda rows, path: logs.write_ocel(rows, path, "session"), lambda spark, path: logs.read_ocel(spark, path, "session")),
}
for _name, (_write, _read) in LOGS.items():

    def _again(spark, d, write=_write, read=_read):
        path = shared_folder(spark) + "/log"
        write(whole(spark, d), path)
        return read(spark, path)

    query(_VARIANTS, f"file_{_name}")(lambda s, d, f=_again: log.slang(logs.log_of(f(s, d))).select(as_text(), "cnt"))
    query(_SEEN if _name != "ocel" else _SEEN.replace("count(DISTINCT event_id % 7) AS resources", "0::BIGINT AS resources"), f"file_{_name}_events")(lambda s, d, f=_again: seen(f(s, d)))


#: Events, about, of an in-memory table on the driver.
TABLE_ROWS = 250_000


@query(_VARIANTS)
def file_pandas(spark, d):
    """An in-memory table is what this source takes: whole cases go through one after the other, as bounded tables."""
    path, rows = shared_folder(spark), whole(spark, d).select("case_id", "pos", "activity", "ts")
    parts = -(-events(spark, d).count() // TABLE_ROWS) or 1
    rows.withColumn("part", F.pmod(F.xxhash64("case_id"), F.lit(parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.withColumn("part", F.lit(0)).schema).parquet(f"{path}/rows")
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        for part in range(parts):
            one = stored.where(F.col("part") == part).orderBy("case_id", "pos")
            frame = one.select(F.col("case_id").alias("case:concept:name"), F.col("activity").alias("concept:name"), F.col("ts").alias("time:timestamp")).toPandas()
            if len(frame) or parts == 1:
                logs.from_pandas(spark, frame).select("case_id", "pos", "activity").write.mode("append").parquet(f"{path}/tables")
    finally:
        spark.conf.set(key, before)
    return log.slang(logs.log_of(spark.read.parquet(f"{path}/tables"))).select(as_text(), "cnt")


@query("SELECT 'session' AS object_type, count(*) AS n FROM log")
def file_ocel_object_types(spark, d):
    path = shared_folder(spark) + "/log"
    logs.write_ocel(whole(spark, d), path, "session")
    return logs.object_types(spark, path).withColumnRenamed("count", "n")
