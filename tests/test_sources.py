"""Log files and streams."""

import gzip
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.plans import catalogue, files
from tracemill.sources import logs
from tracemill.streaming import logs as streams

XES = """<?xml version="1.0" encoding="UTF-8" ?>
<log xes.version="1.0">
  <extension name="Time" prefix="time" uri="http://example.org/time"/>
  <trace><string key="concept:name" value="parcel 7"/><float key="weight" value="2.5"/><boolean key="express" value="true"/>
    <event><date key="time:timestamp" value="2023-11-02T08:30:00.500-02:00"/><string key="org:resource" value="dock &lt;3&gt;"/><string key="concept:name" value="weigh &amp; label"/></event>
    <event><string key="concept:name" value="load"/><int key="truck" value="12"/></event>
    <event><string key="concept:name" value="load"/><int key="truck" value="13"/></event>
  </trace>
  <trace><string key="concept:name" value="parcel 8"/></trace>
  <trace><string key="concept:name" value="parcel 9"/><string key="concept:name" value="parcel 9b"/>
    <event><string key="concept:name" value="return"/></event>
  </trace>
</log>
"""
PARCELS = [(), ("return",), ("weigh & label", "load", "load")]


def traces(df):
    return sorted(tuple(r.trace) for r in df.collect())


@pytest.mark.parametrize("zipped", [False, True])
def test_xes(spark, tmp_path, zipped):
    path = tmp_path / ("x.xes.gz" if zipped else "x.xes")
    path.write_bytes(gzip.compress(XES.encode()) if zipped else XES.encode())
    rows = logs.read_xes(spark, str(path))
    for again in (rows, written(spark, rows, logs.write_xes, logs.read_xes, str(tmp_path / "out"))):
        assert traces(logs.log_of(again)) == PARCELS
        first = again.where("resource is not null").first()
        assert first.resource == "dock <3>" and first.ts.isoformat() == "2023-11-02T10:30:00.500000"
        assert {k: first.case_attributes[k] for k in ("weight", "express")} == {"weight": "2.5", "express": "true"}
        assert sorted(r.attributes["truck"] for r in again.where("activity = 'load'").collect()) == ["12", "13"]
        assert {r.case_attributes["concept:name"] for r in again.collect()} == {"parcel 7", "parcel 8", "parcel 9b"}
    logs.write_xes(logs.log_of(rows), str(tmp_path / "plain"))
    assert traces(logs.log_of(logs.read_xes(spark, str(tmp_path / "plain")))) == PARCELS


def written(spark, rows, write, read, path):
    write(rows, path)
    return read(spark, path)


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("case;act;extra\n1;a;x\n2;b;y\n1;c;z\n")
    rows = logs.read_csv(spark, str(tmp_path / "x.csv"), "case", "act", separator=";")
    assert traces(logs.log_of(rows)) == [("a", "c"), ("b",)] and rows.first().attributes["extra"] == "x"
    logs.write_csv(rows.withColumn("ts", F.timestamp_micros(F.lit(1_500_000))), str(tmp_path / "out"), ["extra"])
    again = logs.read_csv(spark, str(tmp_path / "out"))
    assert traces(logs.log_of(again)) == [("a", "c"), ("b",)]
    assert sorted((r.activity, r.ts.microsecond, r.attributes["extra"]) for r in again.collect()) == [("a", 500_000, "x"), ("b", 500_000, "y"), ("c", 500_000, "z")]


def test_ocel(spark, tmp_path):
    path = tmp_path / "x.ocel"
    path.write_text("""<log><object-types/><objects><object id="pallet-4" type="pallet"/><object id="van-1" type="van"/><object id="van-2" type="van"/></objects><events>
      <event id="n1" type="stack" time="2024-05-30T06:15:00Z"><attributes><attribute name="layers" type="int">3</attribute></attributes><objects><relationship object-id="pallet-4" qualifier="what"/></objects></event>
      <event id="n2" type="drive" time="2024-05-30T07:45:00Z"><attributes/><objects><relationship object-id="van-1" qualifier="by"/><relationship object-id="van-2" qualifier="by"/><relationship object-id="pallet-4" qualifier="what"/></objects></event>
      <event id="n3" type="drive" time="2024-05-30T07:40:00Z"><attributes/><objects><relationship object-id="van-2" qualifier="by"/></objects></event></events></log>""")
    rows = logs.read_ocel(spark, str(path), "pallet")
    assert traces(logs.log_of(rows)) == [("stack", "drive")]
    assert traces(logs.log_of(logs.read_ocel(spark, str(path), "van"))) == [("drive",), ("drive", "drive")]
    assert {r.object_type: r["count"] for r in logs.object_types(spark, str(path)).collect()} == {"pallet": 1, "van": 2}
    again = written(spark, rows, lambda r, p: logs.write_ocel(r, p, "pallet"), lambda s, p: logs.read_ocel(s, p, "pallet"), str(tmp_path / "out"))
    assert traces(logs.log_of(again)) == [("stack", "drive")]
    assert [(r.activity, r.ts.isoformat(), r.attributes) for r in again.orderBy("ts").collect()] == [("stack", "2024-05-30T06:15:00", {"layers": "3"}), ("drive", "2024-05-30T07:45:00", {})]


def test_pandas(spark):
    frame = pd.DataFrame({"case:concept:name": ["1", "2", "1"], "concept:name": ["a", "b", "c"], "time:timestamp": pd.to_datetime(["2020-01-01"] * 3)})
    assert traces(logs.log_of(logs.from_pandas(spark, frame))) == [("a", "c"), ("b",)]


def parts(tmp_path, spark, batches):
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "u string, a string, t string").withColumn("t", F.to_timestamp("t")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1 * (i < len(batches) - 1))
    return spark.readStream.schema("u string, a string, t timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(folder)


def test_streamed_sessions(spark, tmp_path):
    events = parts(tmp_path, spark, [[("x", "a", "2020-01-01 00:00:00"), ("x", "b", "2020-01-01 01:00:00")], [("y", "c", "2020-01-03 00:00:00")], [("z", "d", "2020-01-05 00:00:00")]])
    q = streams.sessions(events, "u", "a", "t").writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert ("a", "b") in traces(spark.table("closed"))


def test_streamed_graph(spark, tmp_path):
    """An event that comes a batch late, but in time, gets its place; equal times go by activity; idle cases end."""
    batches = [
        [("x", "a", "2020-01-01 00:00:00"), ("x", "c", "2020-01-01 01:00:00")],
        [("x", "b", "2020-01-01 00:30:00"), ("x", "e", "2020-01-01 02:00:00"), ("x", "d", "2020-01-01 02:00:00"), ("y", "a", "2020-01-01 02:00:00")],
        [("z", "a", "2020-01-05 00:00:00")],
        [("z", "b", "2020-01-05 00:00:01")],
    ]
    q = streams.follows(parts(tmp_path, spark, batches), "u", "a", "t").writeStream.foreachBatch(streams.graph_sink(str(tmp_path / "g"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    found = {(r.src, r.dst): r.weight for r in streams.graph(spark.read.parquet(str(tmp_path / "g"))).collect()}
    assert found == {(None, "a"): 2, ("a", "b"): 1, ("b", "c"): 1, ("c", "d"): 1, ("d", "e"): 1, ("e", None): 1, ("a", None): 1}


def test_tables_and_executions_come_in_bounded_parts(spark, sf_dir, duck, monkeypatch):
    sizes, tables = [], []
    through, from_pandas = files.through, files.logs.from_pandas
    monkeypatch.setattr(files, "TABLE_ROWS", 300)
    monkeypatch.setattr(files.logs, "from_pandas", lambda s, frame: tables.append(len(frame)) or from_pandas(s, frame))
    found = sorted(map(tuple, files.file_pandas(spark, sf_dir).collect()))
    assert found == sorted(duck.sql(catalogue.SQL["file_pandas"]).fetchall()) and len(tables) > 1 and max(tables) < duck.sql("SELECT count(*) FROM events").fetchall()[0][0]
    monkeypatch.setattr(files, "through", lambda rows, name: sizes.append(len(rows)) or through(rows, name))
    batch = pa.RecordBatch.from_pylist([{"case_id": str(i // 2), "activity": "a", "move_index": i % 2, "fired_transition": 0} for i in range(10)])
    assert [b.num_rows for b in files.through_executions(iter([batch.slice(0, 6), batch.slice(6)]))] == [6, 4] and sizes == [6, 4]
    assert sorted(map(tuple, files.file_exs(spark, sf_dir).collect())) == sorted(duck.sql(catalogue.SQL["file_exs"]).fetchall())
