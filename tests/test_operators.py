"""Operators on small literals, with exact values worked out by hand."""

from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracemill.operators import alignment, analysis, association, conformance, dfg, discovery, distance, filters, log, probability, sampling, statistics
from tracemill.models import discovery as D
from tracemill.models.objects import automaton_of_language, net_of_automaton
from tracemill.sources.formats import from_slang, to_slang

THREE = {("a", "a"): Fraction(1, 5), ("a", "b"): Fraction(1, 5), ("b", "a"): Fraction(3, 5)}


@pytest.fixture(scope="module")
def make(spark):
    return lambda traces: spark.createDataFrame([(i, list(t)) for i, t in enumerate(traces)], "case_id long, trace array<string>")


@pytest.fixture(scope="module")
def three(spark):
    return to_slang(spark, THREE)


def value(df):
    return df.first()[0]


def traces(df):
    return sorted(tuple(r.trace) for r in df.collect())


def test_languages(make, spark, three):
    own = make(["ab", "ab", "", "b"])
    assert sorted((tuple(r.trace), r.cnt, r.n) for r in log.slang(own).collect()) == [((), 1, 4), (("a", "b"), 2, 4), (("b",), 1, 4)]
    assert traces(log.lang(own)) == [(), ("a", "b"), ("b",)]
    assert {r.activity for r in log.activities(own).collect()} == {"a", "b"}
    assert from_slang(three) == THREE
    assert log.slang(make([])).count() == 0


def test_variety_and_medoid(three):
    assert value(analysis.variety(three)) == pytest.approx(2 / 5)
    assert traces(analysis.medoid(three)) == [("b", "a")]
    assert len(traces(analysis.medoid(three, 2))) == 2
    assert traces(analysis.medoid(three, 3, weighted=False)) == sorted(THREE)


def test_filters_remove_what_matches(make):
    ab = make(["a", "b"])
    assert traces(filters.remove_length(ab, "=", 1)) == [] and len(traces(filters.remove_length(ab, ">", 1))) == 2
    for s in ("any", "all", "none", "start", "end"):
        assert len(traces(filters.remove_activity(ab, s, "a"))) == 1
    empty = make(["", "a"])
    assert traces(filters.remove_empty(empty)) == [("a",)]
    assert traces(filters.remove_activity(empty, "all", "a")) == [] and traces(filters.remove_activity(empty, "none", "a")) == [("a",)]
    assert traces(filters.remove_activity(empty, "start", "a")) == [()]
    assert traces(filters.retain(empty, F.size("trace") == 0)) == [()]


def test_graphs(make):
    rows = lambda df: {(r.src, r.dst): r.weight for r in df.collect()}
    own = make(["ab", "aab", ""])
    assert rows(dfg.dfg(own)) == {(None, None): 1, (None, "a"): 2, ("a", "b"): 2, ("a", "a"): 1, ("b", None): 2}
    other = make(["ab", "c"])
    assert value(dfg.edge_difference(dfg.dfg(own), dfg.dfg(other))) == 1 + 1 + 1 + 1 + 1 + 1 + 1
    assert value(dfg.edge_difference_no_frequency(dfg.dfg(own), dfg.dfg(other))) == 4
    assert rows(dfg.dfg_with_fitness(make(["ab"] * 9 + ["ac"]), 0.9)) == {(None, "a"): 9, ("a", "b"): 9, ("b", None): 9}
    assert rows(dfg.dfg_with_fitness(make(["ab"] * 9 + ["ac"]), 1.0))[("a", "c")] == 1
    assert traces(filters.remove_edges(own, own.sparkSession.createDataFrame([("a", "a")], "src string, dst string"))) == [(), ("a", "b")]


def test_conformance(spark, three):
    other = to_slang(spark, {("b", "a"): Fraction(3, 5), ("a", "a"): Fraction(1, 5), ("a", "b"): Fraction(1, 5)})
    for m in (conformance.unit_earth_movers, conformance.hellinger, conformance.chi_squared, conformance.jensen_shannon):
        assert value(m(conformance.probed(three, other))) == pytest.approx(1)
    a, b = to_slang(spark, {("a", "a"): Fraction(1)}), to_slang(spark, {("b", "b"): Fraction(1)})
    assert value(conformance.unit_earth_movers(conformance.probed(a, b))) == 0
    assert value(conformance.jensen_shannon(conformance.probed(a, b))) == pytest.approx(0)
    assert value(conformance.hellinger(conformance.probed(a, b))) == pytest.approx(1 - 0.5**0.5)
    assert value(conformance.chi_squared(conformance.probed(a, b))) == pytest.approx(0.5)
    halves = to_slang(spark, {("a",): Fraction(1, 2), ("b",): Fraction(1, 2)})
    assert value(conformance.entropic_relevance(halves, halves)) == pytest.approx(1)
    assert value(conformance.gain_recall(conformance.probed(halves, halves))) == pytest.approx(1)
    assert value(conformance.markovian(three, other, 2)) == pytest.approx(1)
    assert value(statistics.earth_movers(a, a)) == pytest.approx(1) and value(statistics.earth_movers(a, b)) == pytest.approx(0)
    none = to_slang(spark, {(): Fraction(1)})
    assert value(statistics.earth_movers(none, none)) == pytest.approx(1)
    with pytest.raises(ValueError):
        statistics.earth_movers(a, a.limit(0))


def test_top_k_and_mass(three, spark):
    assert traces(analysis.most_likely(three, 2)) == [("a", "a"), ("b", "a")]
    assert traces(analysis.mode(three)) == [("b", "a")]
    assert traces(analysis.coverage(three, 0.6)) == [("b", "a")] and len(traces(analysis.coverage(three, 0.61))) == 2
    assert traces(analysis.coverage(three, 0.0)) == [] and len(traces(analysis.coverage(three, 1.0))) == 3
    assert traces(analysis.minimum_probability(three, 0.5)) == [("b", "a")]
    assert value(analysis.entropy(three)) == pytest.approx(1.3709505944546687)


def test_completeness(make):
    assert value(analysis.completeness(make(["a", "a", "b", "c"]))) == pytest.approx(3 / (3 + 2 * 2 / 2))
    assert value(analysis.completeness(make(["a", "b"]))) == pytest.approx(2 / 3)
    assert value(analysis.completeness(make([]))) == 0


def test_probabilities(three, make):
    assert value(probability.of_trace(three, ["b", "a"])) == pytest.approx(0.6) and value(probability.of_trace(three, ["c"])) == 0
    assert value(probability.of_log(three, make(["ab", "ab", "ba", "c"]))) == pytest.approx(0.8)


def test_timestamps(spark):
    rows = [("x", 1, "2020-01-01"), ("x", 2, None), ("x", 3, "2020-01-01"), ("y", 1, "2021-01-01")]
    df = spark.createDataFrame(rows, "c string, i int, t string").withColumn("t", F.to_timestamp("t"))
    assert value(analysis.timestamps_ordered(df, "c", "t", ["i"]))
    late = df.union(spark.sql("SELECT 'x', 4, timestamp'2019-01-01'"))
    assert not value(analysis.timestamps_ordered(late, "c", "t", ["i"]))


def test_discovery_tables(make, three):
    own = make(["aba", "ab", ""])
    assert {tuple(r.prefix): r.final for r in discovery.prefix_tree(own).collect()} == {(): True, ("a",): False, ("a", "b"): True, ("a", "b", "a"): True}
    assert {(r.a, r.b): r.weight for r in discovery.short_loops(own).collect()} == {("a", "b"): 1}
    assert {r.activity: r.weight for r in discovery.occurrence_weights(three).collect()} == {"a": pytest.approx(6 / 5), "b": pytest.approx(4 / 5)}
    both = make(["ab", "ba"])
    assert [(r.a, r.b) for r in discovery.concurrent_pairs(dfg.dfg(both), discovery.short_loops(both)).collect()] == [("a", "b")]
    assert discovery.concurrent_pairs(dfg.dfg(own), discovery.short_loops(own), 1.0).count() == 0
    steps = own.sparkSession.createDataFrame([(0, "a"), (1, None), (2, "zz")], "transition int, label string")
    weighted = {r.transition: r.weight for r in discovery.with_weights(steps, discovery.occurrence_weights(three)).collect()}
    assert weighted == {0: pytest.approx(6 / 5), 1: 1, 2: 0}
    assert all(0 < r.weight <= 1 for r in discovery.random_weights(steps, 1).collect())


def test_alignments(three, spark):
    model = net_of_automaton(automaton_of_language({("a", "b"): Fraction(1)}))
    found = alignment.align(three, model)
    kinds = {tuple(r.trace): [m.kind for m in r.moves if m.kind != "silent"] for r in found.collect()}
    assert kinds[("a", "b")] == ["synchronous", "synchronous"]
    assert sorted(kinds[("a", "a")]) == ["log", "model", "synchronous"] and sorted(kinds[("b", "a")]) == ["log", "model", "synchronous"]
    assert value(alignment.trace_fitness(found)) == pytest.approx(1 / 5 + 4 / 5 / 3)
    assert value(alignment.fitting_traces(found)) == pytest.approx(1 / 5)
    assert value(alignment.escaping_edges_precision(found, model)) == pytest.approx(1)
    flower = net_of_automaton(D.flower_automaton("ab"))
    precision = alignment.escaping_edges_precision(alignment.align(three, flower), flower)
    nodes = [(5, 2), (2, 2), (3, 1), (1, 1), (1, 1), (3, 1)]  # counts and ways taken, of three ways each
    assert value(precision) == pytest.approx(sum(c * t for c, t in nodes) / sum(3 * c for c, _ in nodes))


def test_executions(spark):
    rows = [("t1", 0, "a", "2020-01-01 00:00:00", "x"), ("t1", 1, "b", "2020-01-01 02:00:00", "y"), ("t2", 0, "a", "2020-01-01 01:00:00", "y")]
    events = spark.createDataFrame(rows, "case_id string, pos int, activity string, ts string, resource string").withColumn("ts", F.to_timestamp("ts"))
    model = net_of_automaton(automaton_of_language({("a", "b"): Fraction(1)}))
    found = alignment.executions(events, model).orderBy("order_time", "case_id", "move_index").collect()
    assert [(r.case_id, r.activity, r.also_in_log) for r in found] == [("t1", "a", True), ("t2", "a", True), ("t2", "b", False), ("t2", None, False), ("t1", "b", True), ("t1", None, False)]
    assert [r.move_index_of_enablement for r in found if r.case_id == "t1"] == [None, 0, 1]
    used = {(r.case_id, r.activity): r.resource_utilisation for r in alignment.with_utilisation(alignment.executions(events, model)).collect()}
    assert used[("t1", "a")] == 0 and used[("t2", "a")] == 0 and used[("t2", "b")] is None and used[("t1", "b")] == 0
    assert value(alignment.executions_ordered(alignment.executions(events, model)))


def test_samples(three, make, spark):
    drawn = sampling.sample_traces(three, 5000, 3)
    assert {tuple(r.trace): r.cnt / r.n for r in drawn.collect()} == {t: pytest.approx(float(p), abs=0.03) for t, p in THREE.items()}
    own = make(["a"] * 200)
    parts = [sampling.folds(own, 4, k, 7).count() for k in range(4)]
    assert sum(parts) == 200 and min(parts) > 25
    walked = statistics.sample_model(spark, automaton_of_language(THREE), 2000, 1)
    assert {tuple(r.trace): r.cnt / r.n for r in walked.collect()} == {t: pytest.approx(float(p), abs=0.05) for t, p in THREE.items()}
    with pytest.raises(ValueError):
        statistics.sample_model(spark, automaton_of_language({}), 5)


def test_association(spark):
    rows = [(1, ["a"], 1.0, "p"), (2, ["a", "b"], 2.0, "p"), (3, ["a", "b", "c"], 4.0, "q"), (4, ["a"], 1.5, None), (5, [], None, "q")]
    df = spark.createDataFrame(rows, "case_id long, trace array<string>, v double, k string")
    own = [(t, v) for _, t, v, _ in rows if v is not None]
    from tracemill.models.kernels import levenshtein

    pairs = [(abs(v - w), levenshtein(tuple(t), tuple(u)) / max(len(t), len(u))) for t, v in own for u, w in own]
    assert value(association.numeric(df, "v")) == pytest.approx(pd.DataFrame(pairs).corr().iloc[0, 1])
    assert {r.attribute: r.association for r in association.all_attributes(df).collect()} == {"v": pytest.approx(value(association.numeric(df, "v"))), "k": pytest.approx(value(association.categorical(df, "k")))}
    assert -1e-9 <= value(association.categorical(df.where("k is not null"), "k", 40, 30)) <= 2
    same = df.where("trace = array('a')")
    assert value(association.numeric(same, "v")) is None


def test_resampled_sums_are_those_of_the_draws(spark, monkeypatch):
    import random

    import numpy as np

    from tracemill.models.kernels import levenshtein

    rng = random.Random(2)
    cases = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 4))], rng.choice(["x", "y", "z", None])) for i in range(60)]
    df = spark.createDataFrame(cases, "case_id long, trace array<string>, k string")
    monkeypatch.setattr(association, "DRAWS_BYTES", 8 * 40 * 7)  # several passes
    masses, every, equal = association.resampled(df, "k", 20, 30, 4)
    kinds = sorted({("".join(chr(33 + "abc".index(a)) for a in t), v) for _, t, v in cases if v})
    counts = np.array([sum((("".join(chr(33 + "abc".index(a)) for a in t), v) == kind) for _, t, v in cases) for kind in kinds])
    draw, step = np.random.default_rng(4), max(1, 8 * 40 * 7 // (8 * len(kinds)))
    drawn = np.concatenate([draw.multinomial(30, counts / counts.sum(), size=min(step, 20 - at)) for at in range(0, 20, step)])
    d = np.array([[levenshtein(tuple(s), tuple(t)) / max(len(s), len(t), 1) for t, _ in kinds] for s, _ in kinds])
    same = np.array([[v == w for _, w in kinds] for _, v in kinds])
    for w, m, x, y in zip(drawn, masses, every, equal, strict=True):
        assert m.tolist() == [w[[v == u for _, v in kinds]].sum() for u in "xyz"]
        assert x == pytest.approx(w @ d @ w) and y == pytest.approx(w @ (d * same) @ w)


def test_hypothesis_tests(spark, three):
    far = to_slang(spark, {("c", "c", "c"): Fraction(1)}).withColumn("cnt", F.lit(50).cast("long")).withColumn("n", F.lit(50).cast("long"))
    many = three.withColumn("cnt", F.col("cnt") * 20).withColumn("n", F.col("n") * 20)
    assert statistics.bootstrap_test(many, far, 20).first().rejected and not statistics.bootstrap_test(many, many, 20).first().rejected
    assert statistics.permutation_test(many, far, 30).first().rejected and not statistics.permutation_test(many, many, 30).first().rejected
    assert not statistics.permutation_test_model(three, automaton_of_language(THREE), 10).first().rejected
    rows = [(i, ["a", "b"] if i % 2 else ["c"], "odd" if i % 2 else "even") for i in range(40)]
    df = spark.createDataFrame(rows, "case_id long, trace array<string>, k string")
    assert statistics.categorical_test(df, "k", 40).first().rejected


def test_cluster(spark):
    own = to_slang(spark, {tuple("aaaa"): Fraction(1, 4), tuple("aaab"): Fraction(1, 4), tuple("cccc"): Fraction(1, 4), tuple("cccd"): Fraction(1, 4)})
    found = traces(statistics.cluster(own, 2))
    assert len(found) == 2 and {t[0] for t in found} == {"a", "c"}
    assert len(traces(statistics.cluster(own, 4))) == 4
    with pytest.raises(ValueError):
        statistics.cluster(own, 5)


def test_pairs_are_whole(spark):
    rows = spark.createDataFrame([(f"{i:03d}",) for i in range(40)], "code string")
    found = {frozenset((r.a_code, r.b_code)) for r in distance.pairs(rows, 3).collect()}
    assert len(found) == 40 * 39 // 2 == distance.pairs(rows, 3).count() and distance.grid(rows, rows, 3).count() == 1600


def test_sessions(spark):
    rows = [(1, "a", "2020-01-01 00:00:00", 1), (1, "b", "2020-01-01 06:00:00", 2), (1, "c", "2020-01-01 12:00:01", 3), (2, "a", "2020-01-01 00:00:00", 4)]
    df = spark.createDataFrame(rows, "u long, a string, t string, i long").withColumn("t", F.to_timestamp("t"))
    assert traces(log.to_log(log.sessions(df, "u", "t", ["i"]), "case_id", "a", ["t", "i"])) == [("a",), ("a", "b"), ("c",)]


def test_more_than_5000_variants_are_moved_and_their_distances_come_in_parts(spark, monkeypatch):
    names = "abcdefghijklmnopqrst"
    traces = [[x, y, z] for x in names for y in names for z in names[:13]]
    many = spark.createDataFrame([(t, 1, len(traces)) for t in traces], "trace array<string>, cnt long, n long")
    one = spark.createDataFrame([(["a", "b", "c"], 1, 1)], "trace array<string>, cnt long, n long")
    far = [1 - sum(statistics.kernels.levenshtein(t, "abc") for t in traces) / 3 / len(traces)]
    assert len(traces) > 5_000 and value(statistics.earth_movers(many, one)) == pytest.approx(far[0])
    few = many.limit(40).cache()
    x, y, whole = statistics.matrix(few, few)
    monkeypatch.setattr(statistics, "PART_CELLS", 100)
    assert (statistics.matrix(few, few)[2] == whole).all() and whole.any() and statistics.cluster(few, 3).count() == 3


def test_attributes_share_the_distances(spark, monkeypatch):
    df = spark.createDataFrame([("1", ["a"], 1.0, None, 4), ("2", ["a", "b"], 3.0, 5.0, 4), ("3", ["c", "b"], 2.0, 1.0, 9), ("4", ["c"], None, 2.0, 1)], "case_id string, trace array<string>, u double, v double, w int")
    alone = {k: value(association.numeric(df.where(f"{k} is not null"), k)) for k in "uvw"}
    calls, pairs = [], association.pairs
    monkeypatch.setattr(association, "pairs", lambda rows: calls.append(1) or pairs(rows))
    found = {r.attribute: r.association for r in association.all_attributes(df).collect()}
    assert calls == [1] and found == {k: pytest.approx(x) for k, x in alone.items()} and None not in alone.values()
