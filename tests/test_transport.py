"""Edit distances by machine words and transport by network simplex, against plain ones."""

import itertools
import random
import sys

import numpy as np
import pytest

from tracemill.models import edits, kernels
from tracemill.models.transport import planned, transport
from tracemill.operators import statistics


def test_edits_against_plain_ones(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd\U0001f600") for _ in range(rng.randint(0, 12))) for _ in range(150)] + ["", "a" * 300]
    monkeypatch.setattr(edits, "SHEET", 70)
    monkeypatch.setattr(edits, "MOST_PLANES", 3)
    found = edits.edits(words[50:], words)
    assert found.dtype == np.uint16 and all(found[i, j] == kernels.levenshtein(tuple(x), tuple(y)) for i, x in enumerate(words[50:]) for j, y in enumerate(words))
    assert edits.edits([], words).shape == (0, 152) and edits.edits(["", "ab"], [""]).tolist() == [[0], [2]]
    some = edits.Normalised.of(words[:9], words)
    assert some.rows(2, 4).tolist() == [[kernels.levenshtein(tuple(x), tuple(y)) / max(len(x), len(y), 1) for y in words] for x in words[2:4]]


@pytest.mark.parametrize("cost", ["fractions", "any", "below zero"])
def test_transport_against_all_assignments(cost):
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, m = rng.integers(1, 4, 2)
        s = rng.integers(0, 3, n)
        d = np.bincount(rng.integers(0, m, s.sum()), minlength=m)
        c = {"fractions": rng.integers(0, 5, (n, m)) / 4, "any": rng.random((n, m)), "below zero": rng.random((n, m)) - 0.5}[cost]
        left, right = np.repeat(np.arange(n), s), np.repeat(np.arange(m), d)
        want = min(c[left, list(p)].sum() for p in set(itertools.permutations(right)))
        assert transport(s, d, c) == pytest.approx(want, abs=1e-9)


def test_a_way_round_beats_the_straight_one():
    left, right = ["ab", "aba"], ["aba", "ba"]  # not a metric: over a shared trace it is nearer
    assert kernels.earth_movers({tuple(x): 1 for x in left}, {tuple(x): 1 for x in right}) == pytest.approx(1 - 1 / 3)


def test_hundreds_of_variants_are_moved_within_seconds():
    rng = random.Random(1)
    langs = [{tuple(rng.choice("aaabbc") for _ in range(rng.randint(1, 9))): rng.randint(1, 30) for _ in range(900)} for _ in range(2)]
    there, back = kernels.earth_movers(*langs), kernels.earth_movers(*langs[::-1])
    assert there == pytest.approx(back, abs=1e-9) and 0 < there < 1 and kernels.earth_movers(langs[0], langs[0]) == pytest.approx(1)


def test_a_pivot_walks_along_its_cycle_only():
    rng, lines = random.Random(1), itertools.count()
    langs = [sorted({tuple(rng.choice("aaabbc") for _ in range(rng.randint(1, 9))) for _ in range(2000)}) for _ in range(2)]
    cost = edits.Normalised.of(*kernels.coded(*langs))
    s, d = (np.array([rng.randint(1, 30) for _ in x]) for x in langs)
    watch, own = sys.monitoring, transport.__code__.co_filename
    watch.use_tool_id(4, "lines")
    try:
        watch.register_callback(4, watch.events.LINE, lambda code, at: next(lines) * 0 if code.co_filename == own else watch.DISABLE)
        watch.set_events(4, watch.events.LINE)
        kernels.moved(s, d, cost)
    finally:
        watch.set_events(4, 0)
        watch.free_tool_id(4)
    assert next(lines) < 6_000_000  # 11.3 million where a pivot gives what it moves new prices


def test_a_log_of_more_than_5000_variants_is_held_against_its_model(spark, monkeypatch):
    from tracemill.models.objects import automaton_of_language
    from tracemill.sources.formats import from_slang

    names = [chr(97 + i) for i in range(20)]
    rows = [([x, y, z], 1, 5200) for x in names for y in names for z in names[:13]]
    log = spark.createDataFrame(rows, "trace array<string>, cnt long, n long")
    monkeypatch.setattr(kernels, "moved", lambda s, d, c: (s.sum() == d.sum() == 5200) and c.shape == (len(s), len(d)) and 0.0)
    assert statistics.permutation_test_model(log, automaton_of_language(from_slang(log)), 1).first().p == 1.0


def test_clusters_end_when_only_rounding_is_left(spark, monkeypatch):
    rng, passes = random.Random(4), []
    traces = {tuple(rng.choice("aabcd") for _ in range(rng.randint(1, 11))) for _ in range(1500)}
    log = spark.createDataFrame([(list(t), 1, len(traces)) for t in sorted(traces)], "trace array<string>, cnt long, n long")
    part = edits.Normalised.part
    monkeypatch.setattr(edits.Normalised, "part", lambda self, i, j: passes.append(j.copy()) or part(self, i, j))
    assert statistics.cluster(log, 3).count() == 3
    assert len(passes) < 100 and len({tuple(sorted(p.tolist())) for p in passes}) == len(passes)  # no medoids come twice


@pytest.mark.parametrize("kind", ["numeric", "categorical"])
def test_cells_have_every_pair_once_each_way_without_a_join(spark, monkeypatch, kind):
    from tracemill.operators import association, distance

    rng = random.Random(6)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 6))], rng.choice([None, 1.0, 2.5, 7.0])) for i in range(120)]
    monkeypatch.setattr(distance, "CELL_ROWS", 9)
    monkeypatch.setattr(association, "AT_ONCE", 40)
    df = spark.createDataFrame(rows, "case_id long, trace array<string>, v double")
    held = [(t, v) for _, t, v in rows if v is not None]
    d = np.array([[kernels.levenshtein(s, t) / max(len(s), len(t), 1) for t, _ in held] for s, _ in held])
    if kind == "numeric":
        far = np.array([[abs(v - w) for _, w in held] for _, v in held])
        assert association.numeric(df, "v").first()[0] == pytest.approx(np.corrcoef(far.ravel(), d.ravel())[0, 1])
        return
    masses, every, equal = association.resampled(df, "v", 3, None, 1)
    assert (masses.sum(axis=1) == len(held)).all() and (0 < equal).all() and (equal < every).all()
    monkeypatch.setattr(np.random, "default_rng", lambda seed: type("All", (), {"multinomial": lambda self, n, p, size: np.round(np.outer(np.ones(size), p * n)).astype(int)})())
    _, every, equal = association.resampled(df, "v", 1, None, 1)
    same = np.array([[v == w for _, w in held] for _, v in held])
    assert every[0] == pytest.approx(d.sum()) and equal[0] == pytest.approx((d * same).sum())


def test_a_search_ends_where_enough_is_known():
    rng, short = np.random.default_rng(6), 0
    for _ in range(60):
        n, m = rng.integers(1, 40, 2)
        supply, demand, cost = rng.integers(1, 5, n) * m, np.full(m, 0), rng.integers(0, 9, (n, m)) / 8
        demand += supply.sum() // m
        least = transport(supply, demand, cost)
        assert planned(supply, demand, edits.Dense(cost)) >= least - 1e-9
        for enough in (-np.inf, 0, 0.9 * least, least, 1.05 * least, 2 * least):
            found = transport(supply, demand, cost, enough)
            assert least - 1e-9 <= found and (found < enough or abs(found - least) < 1e-9)
            short += found > least + 1e-9
    assert short
