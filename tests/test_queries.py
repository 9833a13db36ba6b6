"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and give rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import comparable
from tracemill.plans import catalogue, files, literals, models  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    ours, theirs = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_plans_push_down_and_stay_in_the_jvm(spark, sf_dir):
    plan = catalogue.dfg_full(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "props" not in plan and "value" not in plan.split("ReadSchema")[1]


def test_imports_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e, tracemill.plans.commands; print(len(e.queries()) > 80, len(e.oracle_sql()) > 60)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0]).stdout.split() == ["True", "True"]


def test_workers_can_import_from_any_folder(tmp_path):
    import os
    import subprocess
    import sys

    code = """
import sys; sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["probability_of_model"](spark, sys.argv[2]).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, __file__.rsplit("/", 2)[0], "/root/testdata/sf0.001"], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert "rows " in done.stdout, done.stderr[-2000:]
