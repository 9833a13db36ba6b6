"""Resampling tests whose distances are too many to be sent to the tasks, or to be held in memory."""

import itertools
import pickle
import random

import numpy as np
import pytest

from tracemill.models import edits
from tracemill.operators import statistics


def language(spark, rng, n):
    traces = sorted({tuple(rng.choice("aabcd") for _ in range(rng.randint(0, 7))) for _ in range(n)})
    return spark.createDataFrame([(list(t), rng.randint(1, 4), 1000) for t in traces], "trace array<string>, cnt long, n long")


def outcome(spark, name):
    from tracemill.models.objects import automaton_of_language
    from tracemill.sources.formats import from_slang

    rng = random.Random(8)
    a, b = language(spark, rng, 40), language(spark, rng, 50)
    other = automaton_of_language(from_slang(b)) if name == "permutation_test_model" else b
    return getattr(statistics, name)(a, other, 12).first().asDict()


def test_distances_in_a_file_are_those_in_memory(monkeypatch):
    monkeypatch.setattr(edits, "MADE", 100)
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["a" * 300]
    held, filed = edits.Normalised.of(words[20:], words), edits.Filed(words[20:], words)
    for i, j in [(np.arange(41), np.arange(61)), (np.array([0, 7, 40]), np.array([3, 4, 60])), (np.array([5]), np.array([20]))]:
        for some in (filed, pickle.loads(pickle.dumps(filed))):
            assert some.part(i, j).shape == (len(i), len(j))
            assert all((some.part(i, j).rows(lo, hi) == held.part(i, j).rows(lo, hi)).all() for lo, hi in [(0, 2), (1, 3), (0, len(i))])
    assert filed.kind == np.uint16 and filed.file is not None and pickle.loads(pickle.dumps(filed)).file is None


@pytest.mark.parametrize("name", ["bootstrap_test", "permutation_test", "permutation_test_model"])
def test_results_are_the_same_with_distances_in_files(spark, monkeypatch, name):
    held = outcome(spark, name)
    monkeypatch.setattr(statistics, "fits", lambda *codes: False)
    assert outcome(spark, name) == held


@pytest.mark.parametrize("name", ["bootstrap_test", "permutation_test"])
def test_more_distances_than_can_be_sent_are_no_error(spark, monkeypatch, name):
    names, sent, replicated = [chr(97 + i) for i in range(29)], [], statistics.replicated
    log = spark.createDataFrame([(list(t), 1, 29**3) for t in itertools.product(names, repeat=3)], "trace array<string>, cnt long, n long")
    monkeypatch.setattr(statistics, "replicated", lambda s, k, shared, *a: sent.append(len(pickle.dumps(shared))) or replicated(s, k, shared, *a))
    assert getattr(statistics, name)(log, log).columns == ["base", "p", "rejected"]
    assert sent[0] < 5_000_000  # 595 MB of distances, an error


def test_plans_decide_as_the_least_distances_do(spark):
    from tracemill.models import kernels

    rng = random.Random(8)
    a, b = language(spark, rng, 40), language(spark, rng, 50)
    codes, x, y = statistics._pool(a, b)
    cost, values = edits.Normalised.of(codes, codes), []
    for left in [*(np.random.default_rng([0, i]).multivariate_hypergeometric(x + y, int(x.sum()), method="marginals") for i in range(30)), x]:
        values.append(kernels.moved(left[left > 0], (x + y - left)[x + y > left], cost.part(np.flatnonzero(left), np.flatnonzero(x + y - left))))
    got = statistics.permutation_test(a, b, 30).first()
    assert got.base == pytest.approx(1 - values[-1], abs=1e-12) and got.p == np.mean(np.array(values[:-1]) >= values[-1])
