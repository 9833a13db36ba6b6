"""Queries over languages pass all variants and cases, and the operators' own numbers of replicates."""

import pytest

from tracemill.operators import association, statistics
from tracemill.plans import catalogue, models


@pytest.mark.parametrize("name", ["bootstrap_test", "permutation_test", "permutation_test_model", "cluster"])
def test_all_variants_reach_the_operator(spark, sf_dir, monkeypatch, name):
    seen = []
    monkeypatch.setattr(statistics, name, lambda *a, **k: seen.append((a, k)) or spark.createDataFrame([(0.0, 0.0, ["a"])], "base double, p double, trace array<string>"))
    catalogue.QUERIES[name](spark, sf_dir)
    (given, options), halves = seen[0], [catalogue.session_slang(spark, sf_dir, p) for p in ([None] if name == "cluster" else [0, 1])]
    for own, whole in zip(given, halves[: 1 if name in ("permutation_test_model", "cluster") else 2], strict=False):
        rows = lambda df: {(tuple(r.trace), r.cnt) for r in df.collect()}
        assert rows(own) == rows(whole)
    assert not options and not any(isinstance(x, int) for x in given[: 1 if name == "cluster" else None])


@pytest.mark.parametrize("name", ["categorical_attribute_test", "association_categorical"])
def test_all_cases_reach_the_operator(spark, sf_dir, monkeypatch, name):
    seen = []
    made = spark.createDataFrame([(0.0,)], "p double")
    monkeypatch.setattr(*((association, "categorical") if name == "association_categorical" else (statistics, "categorical_test")), lambda *a, **k: seen.append((a, k)) or made)
    catalogue.QUERIES[name](spark, sf_dir)
    (given, options) = seen[0]
    assert given[0].count() == catalogue.session_log(spark, sf_dir).count() and given[1:] == ("half",) and not options


def test_explanations_and_distances_have_all_variants(spark, sf_dir):
    n = catalogue.session_slang(spark, sf_dir).count()
    assert models.explain_trace(spark, sf_dir).count() == n
    assert catalogue.distance_matrix(spark, sf_dir).count() == n * (n - 1) // 2
