"""Helpers shared by the training-data operators: table access, lineage cuts and Arrow mapping."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Largest object, in bytes, that an operator broadcasts; beyond it each operator has another way, stated there.
BROADCAST_BYTES = 64 << 20
#: Rows, and bytes about, that a task turns to Python objects at once.
PART_ROWS, PART_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of its own only in local mode, where the session names none, as in tests."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"a cluster needs {CHECKPOINT_KEY}, a folder that all its machines share")
        found = _own_folder()
    return found


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tracemill-")


def _path(spark: SparkSession, path: str) -> tuple:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Cuts lineage: writes ``df`` to the shared folder and reads it back, so that a lost executor costs no recomputation.

    The table lives until it is :func:`dropped`, its :func:`scratch` ends, or the driver does.
    """
    spark, path = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    there, files = _path(spark, path)
    files.deleteOnExit(there)
    for made in _SCRATCH:
        made.add(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table made by :func:`written` that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        there, files = _path(df.sparkSession, path)
        files.delete(there, True)


def settled(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, for which it waits until memory is short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SCRATCH: list[set[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes at its end the tables that were :func:`written` inside, but for those taken out of the set it gives."""
    _SCRATCH.append(made := set())
    try:
        yield made
    finally:
        _SCRATCH[:] = [m for m in _SCRATCH if m is not made]
        for path in made:
            there, files = _path(spark, path)
            files.delete(there, True)


def map_rows(df: DataFrame, work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over column lists; each input batch is cut so that a part holds few rows and few bytes (a row at least)."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict[str, list]]:
            for batch in batches:
                step = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(batch.nbytes, 1)))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        for out in work(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def own_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Only the columns an operator reads, so that further ones, whatever their names, can't clash with its own."""
    return df.select(*[df[n] for n in names])


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with those of its columns that have one of the names renamed, and what names them back."""
    other = {c: f"{c}-{uuid.uuid4().hex}" for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(other), lambda out: out.withColumnsRenamed({v: k for k, v in other.items()})
