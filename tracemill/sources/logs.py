"""Event-log files as DataFrames: XES, CSV, OCEL and in-memory tables.

All readers give the long event table ``(case_id, pos, activity, ts, resource, attributes, case_attributes)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("string", "int", "float", "date", "boolean", "id")
_VALUE = "array<struct<_key: string, _value: string>>"
_EVENT = ", ".join(f"{k}: {_VALUE}" for k in KINDS)
#: An explicit schema: inference would make a struct of a trace's only event.
XES_SCHEMA = f"{', '.join(f'{k} {_VALUE}' for k in KINDS)}, event array<struct<{_EVENT}>>"


def _values(prefix: str = "") -> F.Column:
    """All attributes of an element as one map; of a key given twice the last of the last kind stays."""
    each = F.flatten(F.array_compact(F.array(*[F.transform(prefix + k, lambda x: F.struct(x["_key"].alias("key"), x["_value"].alias("value"))) for k in KINDS])))
    keys = F.transform(each, lambda x: x["key"])
    last = F.filter(each, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
    return F.map_from_entries(last)


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """Also reads .xes.gz. Traces are numbered in file order within each part of a file; empty traces have one row without
    a position."""
    rows = spark.read.schema(XES_SCHEMA).option("rowTag", "trace").format("xml").load(path)
    rows = rows.withColumn("case_attributes", _values()).withColumn("_n", F.monotonically_increasing_id())
    rows = rows.withColumn("case_id", F.concat_ws("#", F.coalesce(F.element_at("case_attributes", F.lit("concept:name")), F.lit("")), F.col("_n").cast("string")))
    each = rows.select("case_id", "case_attributes", F.posexplode_outer("event").alias("pos", "e")).withColumn("attributes", F.when(F.col("pos").isNotNull(), _values("e.")))
    at = lambda k: F.element_at("attributes", F.lit(k))
    return each.select("case_id", "pos", at("concept:name").alias("activity"), F.try_to_timestamp(at("time:timestamp")).alias("ts"), at("org:resource").alias("resource"), "attributes", "case_attributes")


def read_csv(spark: SparkSession, path: str, case: str = "case:concept:name", activity: str = "concept:name", time: str | None = "time:timestamp", resource: str | None = "org:resource", separator: str = ",") -> DataFrame:
    """Events keep the order of the file, also where the rows of cases are interleaved: a position is the file, where in it
    the block begins, and the row's number, so it doesn't hang on which task reads which block."""
    rows = spark.read.option("header", True).option("sep", separator).csv(path)
    rows = rows.withColumn("_n", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))
    c = lambda n: F.col(f"`{n}`") if n and n in rows.columns else F.lit(None).cast("string")
    others = [n for n in rows.columns if n not in (case, activity, time, resource, "_n")]
    attributes = F.create_map(*[x for n in others for x in (F.lit(n), c(n))]) if others else F.lit(None).cast("map<string,string>")
    return rows.select(c(case).alias("case_id"), F.col("_n").alias("pos"), c(activity).alias("activity"), F.try_to_timestamp(c(time)).alias("ts"), c(resource).alias("resource"), attributes.alias("attributes"), F.lit(None).cast("map<string,string>").alias("case_attributes"))


OCEL_SCHEMA = "_id string, _type string, _time string, objects struct<relationship: array<struct<`_object-id`: string, _qualifier: string>>>, attributes struct<attribute: array<struct<_name: string, _VALUE: string>>>"


def read_ocel(spark: SparkSession, path: str, object_type: str) -> DataFrame:
    """Flattened to one object type: a case per object, an event in the case of every object of the type it refers to."""
    events = spark.read.schema(OCEL_SCHEMA).option("rowTag", "event").format("xml").load(path)
    objects = spark.read.schema("_id string, _type string").option("rowTag", "object").format("xml").load(path)
    own = objects.where(F.col("_type") == object_type).select(F.col("_id").alias("case_id"))
    told = F.transform(F.coalesce("attributes.attribute", F.array()), lambda a: F.struct(a["_name"].alias("key"), a["_VALUE"].alias("value")))
    each = events.select(F.array_distinct("objects.relationship.`_object-id`").alias("cases"), F.monotonically_increasing_id().alias("pos"), F.col("_type").alias("activity"), F.try_to_timestamp("_time").alias("ts"), told.alias("attributes"))
    each = each.withColumn("case_id", F.explode("cases"))
    return each.join(own, "case_id", "left_semi").select("case_id", "pos", "activity", "ts", F.lit(None).cast("string").alias("resource"), F.map_from_entries("attributes").alias("attributes"), F.lit(None).cast("map<string,string>").alias("case_attributes"))


def object_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, _type string").option("rowTag", "object").format("xml").load(path).groupBy(F.col("_type").alias("object_type")).count()


def from_pandas(spark: SparkSession, frame, case: str = "case:concept:name", activity: str = "concept:name", time: str = "time:timestamp", resource: str = "org:resource") -> DataFrame:
    """From an in-memory table with one row per event, in order."""
    rows = spark.createDataFrame(frame.reset_index(drop=True).rename_axis("_n").reset_index())
    c = lambda n, kind="string": F.col(f"`{n}`").cast(kind) if n in rows.columns else F.lit(None).cast(kind)
    return rows.select(c(case).alias("case_id"), F.col("_n").alias("pos"), c(activity).alias("activity"), c(time, "timestamp").alias("ts"), c(resource).alias("resource"), F.lit(None).cast("map<string,string>").alias("attributes"), F.lit(None).cast("map<string,string>").alias("case_attributes"))


def log_of(events: DataFrame) -> DataFrame:
    """(case_id, trace), cases without events included."""
    rows = events.groupBy("case_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "activity")))).alias("e"))
    return rows.select("case_id", F.col("e.activity").alias("trace"))


def cases(rows: DataFrame) -> DataFrame:
    """Of a log (case_id, trace) or of events, one row per case: case_id, case_attributes, events in order."""
    if "trace" in rows.columns:
        each = F.transform("trace", lambda a, i: F.struct(i.cast("int").alias("at"), a.alias("activity"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("resource"), F.lit(None).cast("map<string,string>").alias("attributes")))
        return rows.select(F.col("case_id").cast("string").alias("case_id"), F.lit(None).cast("map<string,string>").alias("case_attributes"), each.alias("events"))
    own = F.when(F.col("pos").isNotNull(), F.struct("pos", "activity", "ts", "resource", F.map_entries("attributes").alias("attributes")))
    own = rows.groupBy(F.col("case_id").cast("string").alias("case_id")).agg(F.array_sort(F.collect_list(own)).alias("e"), F.max(F.map_entries("case_attributes")).alias("c"))
    each = F.transform("e", lambda x, i: F.struct(i.cast("int").alias("at"), x["activity"].alias("activity"), x["ts"].cast("timestamp").alias("ts"), x["resource"].alias("resource"), F.map_from_entries(x["attributes"]).alias("attributes")))
    return own.select("case_id", F.map_from_entries("c").alias("case_attributes"), each.alias("events"))


def _parts(rows: DataFrame, head: list[str], told, tail: list[str], path: str, compression: str | None) -> None:
    """A folder of text files, each a whole document: ``told`` gives the lines of a case."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": head})
        for b in batches:
            for start in range(0, b.num_rows, 256):
                found = [x for row in b.slice(start, 256).to_pylist() for x in told(row)]
                yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.string())], names=["value"])
        yield pa.RecordBatch.from_pydict({"value": tail})

    rows.mapInArrow(parts, T.StructType([T.StructField("value", T.StringType())])).write.text(path, compression=compression)


def _said(kind: str, key: str, value: str) -> str:
    return f"<{kind} key={quoteattr(key)} value={quoteattr(value)}/>"


def _time(ts) -> str:
    return ts.isoformat() if ts.tzinfo else f"{ts.isoformat()}+00:00"


def write_xes(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """Of a log or of events: a folder of parts, each a whole log, with times, resources and attributes as far as known.

    Attributes are written as strings, since the table holds them so; those of a case beside its name.
    """

    def told(row: dict) -> list[str]:
        case = dict(row["case_attributes"] or {})
        out = [_said("string", "concept:name", case.pop("concept:name", row["case_id"])), *(_said("string", k, v) for k, v in case.items() if v is not None)]
        for e in row["events"]:
            own = [("string", "concept:name", e["activity"]), ("date", "time:timestamp", e["ts"] and _time(e["ts"])), ("string", "org:resource", e["resource"])]
            own += [("string", k, v) for k, v in e["attributes"] or [] if k not in ("concept:name", "time:timestamp", "org:resource")]
            out.append(f"<event>{''.join(_said(*x) for x in own if x[2] is not None)}</event>")
        return [f"<trace>{''.join(out)}</trace>"]

    _parts(cases(rows), ['<?xml version="1.0" encoding="UTF-8"?>', '<log xes.version="1.0">'], told, ["</log>"], path, compression)


def write_csv(rows: DataFrame, path: str, attributes: list[str] | None = None) -> None:
    """Of a log or of events: one row per event, those of a case together and in order, with times and resources as far as
    known, and a column for each of the ``attributes`` named."""
    each = cases(rows).select("case_id", F.explode("events").alias("e")).repartition("case_id").sortWithinPartitions("case_id", "e.at")
    others = [F.element_at("e.attributes", F.lit(a)).alias(a) for a in attributes or []]
    each.select(F.col("case_id").alias("case:concept:name"), F.col("e.activity").alias("concept:name"), F.date_format("e.ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time:timestamp"), F.col("e.resource").alias("org:resource"), *others).write.option("header", True).csv(path)


def write_ocel(rows: DataFrame, path: str, object_type: str = "case") -> None:
    """Of a log or of events: a folder of parts, each a whole log of objects, one per case, and events, with times and
    attributes as far as known."""

    def told(row: dict) -> list[str]:
        case = quoteattr(row["case_id"])
        out = [f"<objects><object id={case} type={quoteattr(object_type)}/></objects><events>"]
        for e in row["events"]:
            time = f" time={quoteattr(_time(e['ts']))}" if e["ts"] else ""
            own = "".join(f'<attribute name={quoteattr(k)} type="string">{escape(v)}</attribute>' for k, v in e["attributes"] or [] if v is not None)
            out.append(f"<event id={quoteattr(row['case_id'] + ':' + str(e['at']))} type={quoteattr(e['activity'] or '')}{time}><attributes>{own}</attributes><objects><relationship object-id={case} qualifier={quoteattr(object_type)}/></objects></event>")
        return ["".join(out) + "</events>"]

    _parts(cases(rows), ["<log>", f"<object-types><object-type name={quoteattr(object_type)}/></object-types>"], told, ["</log>"], path, None)
