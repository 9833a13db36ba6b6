"""Makes the package importable for the Python workers."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def importable(spark: SparkSession) -> None:
    """Sends the package to all executors, once per context, unless their path already has it."""
    sc = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(ROOT) in map(os.path.realpath, filter(None, known)) or getattr(sc, "_tracemill_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="tracemill-code-")  # stays, as executors that start later fetch it from the driver
    copy = Path(folder, "code")
    shutil.copytree(ROOT / "tracemill", copy / "tracemill", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder, "tracemill")), "zip", copy))
    sc._tracemill_sent = True


def shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run
