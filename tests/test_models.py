"""Models: semantics, exact probabilities, reduction, discovery and file formats."""

import itertools
import random
import time
from fractions import Fraction as Fr

import numpy as np
import pytest

from tracemill.models import discovery as D
from tracemill.models import kernels as K
from tracemill.models import markov as M
from tracemill.models import objects as O
from tracemill.models import reduce as R
from tracemill.models import semantics as S
from tracemill.models import tree as T
from tracemill.sources import formats

LANGUAGE = {("a", "a"): Fr(1, 5), ("a", "b"): Fr(1, 5), ("b", "a"): Fr(3, 5)}
a, b, c, tau = T.activity("a"), T.activity("b"), T.activity("c"), T.TAU


def language(model, longest=6, most=400):
    out = set()
    for _, t in itertools.islice(M.enumerated(model), most):
        if len(t) <= longest:
            out.add(t)
    return out


def all_traces(thing):
    return {t for _, t in M.minimum_probability(O.as_model(thing), Fr(0))}


@pytest.mark.parametrize(
    ("tree", "traces"),
    [
        (T.node("xor", [a, b, tau]), ["a", "b", ""]),
        (T.node("sequence", [a, T.node("xor", [b, c])]), ["ab", "ac"]),
        (T.node("concurrent", [a, T.node("sequence", [b, c])]), ["abc", "bac", "bca"]),
        (T.node("interleaved", [T.node("sequence", [a, b]), c]), ["abc", "cab"]),
        (T.node("or", [a, b]), ["a", "b", "ab", "ba"]),
        (T.node("or", [a]), ["a"]),
        (tau, [""]),
    ],
)
def test_tree_languages(tree, traces):
    assert all_traces(tree) == {tuple(t) for t in traces}
    assert all_traces(T.reduced(tree)) == {tuple(t) for t in traces}
    assert T.empty_traces(tree) == ("" in traces) and not T.infinitely_many(tree)
    assert all_traces(R.reduced(T.net_of(tree))) == {tuple(t) for t in traces}
    assert O.as_model(O.diagram_of_tree(tree)) and all_traces(O.diagram_of_tree(tree)) >= {tuple(t) for t in traces} or tree.kind in ("interleaved",)


def test_loops():
    tree = T.node("loop", [a, b, c])
    assert {t for t in language(T.net_of(tree)) if len(t) <= 3} == {("a",), ("a", "b", "a"), ("a", "c", "a")}
    assert S.infinitely_many_traces(T.net_of(tree)) and T.infinitely_many(tree) and S.any_traces(T.net_of(tree))


def random_tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([a, b, c, tau])
    kind = rng.choice(["xor", "sequence", "concurrent", "or", "interleaved", "loop"])
    return T.node(kind, [random_tree(rng, depth - 1) for _ in range(2 if kind == "loop" else rng.randint(1, 3))])


def test_reduction_keeps_the_language():
    rng = random.Random(8)
    done = 0
    while done < 60:
        tree = random_tree(rng, 2)
        if T.infinitely_many(tree) or "loop" in str(tree):
            continue
        done += 1
        want = all_traces(tree)
        assert all_traces(T.reduced(tree)) == want, str(tree)
        assert all_traces(R.reduced(T.net_of(tree))) == want, str(tree)
    loop = T.node("loop", [T.node("xor", [a, tau]), T.node("xor", [b, tau])])
    assert {t for t in language(T.net_of(loop), 3, 3000) if len(t) <= 3} == {t for t in language(T.net_of(T.reduced(loop)), 3, 3000) if len(t) <= 3}


def test_prefix_automaton_gives_the_language_back():
    model = O.automaton_of_language(LANGUAGE)
    assert {t: p for p, t in M.enumerated(model)} == LANGUAGE
    assert [M.trace_probability(model, t) for t in (("a", "a"), ("b", "a"), ("c",))] == [Fr(1, 5), Fr(3, 5), 0]
    assert M.entropy(model) == pytest.approx(1.3709505944546687)
    assert [t for _, t in M.most_likely(model, 1)] == [("b", "a")]
    assert [t for _, t in M.coverage(model, Fr(3, 5))] == [("b", "a")] and M.coverage(model, Fr(0)) == []
    assert sum(M.abstraction(model, 2).values()) == 1
    missing = O.automaton_of_language({("a",): Fr(1, 2)})
    assert M.trace_probability(missing, ("a",)) == Fr(1, 2)
    with pytest.raises(ValueError):
        M.coverage(missing, Fr(3, 4))


def test_livelocks_and_silent_steps():
    # a with 2/5, b with 1/5, and 2/5 that never ends
    auto = S.Automaton(4, 0, [S.Edge(0, 1, "a", Fr(2, 5)), S.Edge(0, 2, "b", Fr(1, 5)), S.Edge(0, 3, None, Fr(2, 5)), S.Edge(3, 3, "c", Fr(1))], {1: Fr(1), 2: Fr(1)})
    assert [M.trace_probability(auto, t) for t in (("a",), ("b",), ("c",), ())] == [Fr(2, 5), Fr(1, 5), 0, 0]
    assert S.any_traces(auto) and not S.infinitely_many_traces(auto)
    assert S.non_decreasing_livelock(auto, 3) and not S.non_decreasing_livelock(auto, 1)
    silent = S.Automaton(2, 0, [S.Edge(0, 0, None, Fr(1, 2)), S.Edge(0, 1, "a", Fr(1, 4))], {0: Fr(1, 4), 1: Fr(1)})
    assert M.trace_probability(silent, ("a",)) == Fr(1, 2) and M.trace_probability(silent, ()) == Fr(1, 2)
    visible = M.without_silent(silent)
    assert all(e.label for e in visible.edges) and M.trace_probability(visible, ("a",)) == Fr(1, 2)


def test_boundedness():
    grows = S.Net(1, (0,), [S.Transition("a", {}, {0: 1})])
    assert not S.bounded(grows) and S.bounded(T.net_of(T.node("concurrent", [a, b])))
    with pytest.raises(S.TooManyStates):
        S.explored(grows, 100)


def test_alignments_are_cheapest():
    rng = random.Random(2)
    for _ in range(40):
        traces = {tuple(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(3)}
        model = O.as_model(traces)
        trace = tuple(rng.choice("abc") for _ in range(rng.randint(0, 5)))
        moves = K.align(model, trace)
        assert tuple(x for k, x, _ in moves if k in ("synchronous", "log")) == trace
        assert tuple(x for k, x, _ in moves if k in ("synchronous", "model")) in traces
        lcs = lambda x, y: len(x) + len(y) - 2 * max(len(s) for n in range(len(x) + 1) for s in itertools.combinations(x, n) if s in {q for m in range(len(y) + 1) for q in itertools.combinations(y, m)})
        assert sum(k in ("log", "model") for k, *_ in moves) == min(lcs(trace, t) for t in traces)
    with pytest.raises(K.NoAlignment):
        K.align(O.as_model(set()), ("a",))


def test_explanations_end():
    moves = K.explain(O.automaton_of_language(LANGUAGE), ["b", "a"])
    assert [k for k, *_ in moves if k != "silent"] == ["synchronous", "synchronous"]


def test_transport_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        s = np.array([rng.randint(1, 2) for _ in range(n)])
        d = np.bincount([rng.randrange(m) for _ in range(s.sum())], minlength=m)
        cost = np.array([[rng.choice([0, 0.25, 0.5, 1, 0.3]) for _ in range(m)] for _ in range(n)])
        left, right = np.repeat(np.arange(n), s), np.repeat(np.arange(m), d)
        assert K.transport(s, d, cost) == pytest.approx(min(cost[left, list(p)].sum() for p in set(itertools.permutations(right))))


def test_partial_orders():
    one = [("a", ()), ("b", ())]
    assert K.order_distance(one, [("b", ()), ("a", (0,))]) == 0 and K.order_distance([], []) == 0
    assert K.order_distance([("a", ()), ("b", (0,))], [("b", ()), ("a", (0,))]) == 1
    from tracemill.operators.statistics import earth_movers_orders

    assert earth_movers_orders([O.Order(one, Fr(1))], [O.Order(one, Fr(1))]) == pytest.approx(1)


@pytest.mark.parametrize("noise", [None, Fr(1, 5)])
def test_inductive_miner_replays_its_log(noise):
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 6)
        own = {tuple(rng.choice("abcd") for _ in range(rng.randint(0, 5))): Fr(1, n) for _ in range(n)}
        tree = D.inductive(own, noise)
        if noise is None:
            for t in own:
                assert not [k for k, *_ in K.align(T.net_of(tree), t) if k in ("log", "model")], (own, str(tree), t)


@pytest.mark.parametrize(
    ("traces", "tree"),
    [
        (["abcd", "acbd"], "sequence(a, concurrent(b, c), d)"),
        (["a", "b"], "xor(a, b)"),
        (["ab", ""], "xor(tau, sequence(a, b))"),
        (["aba", "a", "ababa"], "loop(a, b)"),
        (["abc", "acb", "bac", "bca", "cab", "cba"], "concurrent(a, b, c)"),
        (["a", "aa"], "loop(a, tau)"),
    ],
)
def test_inductive_miner_finds_the_cut(traces, tree):
    assert str(D.inductive({tuple(t): Fr(1, len(traces)) for t in traces})) == tree


def test_infrequent_behaviour_is_left_out():
    own = {("a", "b", "c"): Fr(99, 100), ("c", "a"): Fr(1, 100)}
    assert str(D.inductive(own, Fr(1, 5))) == "sequence(a, b, c)" and str(D.inductive(own)) != "sequence(a, b, c)"


def test_simple_models():
    traces = set(LANGUAGE)
    assert all_traces(D.trace_tree(traces)) == all_traces(D.prefix_tree(traces)) == all_traces(D.prefix_automaton(traces)) == traces
    assert {("a", "b"), (), ("b",)} <= language(T.net_of(D.flower_tree("ab"))) and {(), ("b", "a")} <= language(D.flower_automaton("ab"))
    net = D.occurrence(T.net_of(T.node("xor", [a, b, tau])), {"a": Fr(3)})
    assert [t.weight for t in net.transitions] == [3, 0, 1, 1]
    assert all(0 < x.weight <= 1 for x in D.randomised(T.node("xor", [a, b]), 1).leaves()) and all(t.weight == 1 for t in D.uniform(net).transitions)
    weighted = D.by_alignments(net, [O.Alignment([("synchronous", "a", 0), ("log", "z", None), ("silent", None, 3)], Fr(1, 2))])
    assert [t.weight for t in weighted.transitions] == [Fr(1, 2), 0, 0, Fr(1, 2)]


@pytest.mark.parametrize("traces", [["abd", "acd"], ["abcd", "acbd"], ["ab", "aab", "abb"], ["a"], ["abe", "acde", "adce"]])
def test_split_miner_replays_clear_logs(traces):
    own = {tuple(t): Fr(1, len(traces)) for t in traces}
    model = O.as_model(D.split_miner(own, eta=Fr(0)))
    for t in own:
        assert not [k for k, *_ in K.align(model, t) if k in ("log", "model")], t


def things():
    yield "lang", set(LANGUAGE)
    yield "slang", LANGUAGE
    yield "spolang", [O.Order([("a", ()), ("two\nlines", (0,))], Fr(1, 2)), O.Order([], Fr(1, 2))]
    g = O.graph_of_language(LANGUAGE)
    yield "dfg", g
    yield "sdfm", g
    yield "dfm", O.FollowsGraph(["a", "b"], Fr(1), {"a": Fr(1)}, {"b": Fr(1)}, {("a", "b"): Fr(1)})
    yield "dfa", D.prefix_automaton(set(LANGUAGE))
    yield "sdfa", O.automaton_of_language(LANGUAGE)
    yield "snfa", S.Automaton(2, 0, [S.Edge(0, 1, None, Fr(1, 2)), S.Edge(0, 1, "a", Fr(1, 2))], {1: Fr(1)})
    net = T.net_of(T.node("concurrent", [a, T.node("loop", [b, tau])]))
    for n in ("lpn", "slpn", "pnml"):
        yield n, net
    tree = T.node("xor", [T.node("sequence", [a, b]), tau])
    for n in ("ptree", "sptree", "ptml"):
        yield n, tree
    yield "powl", O.Powl("partial_order", None, False, True, [O.Powl("activity", "a"), O.Powl("activity", "b", True)], [(0, 1)])
    for n in ("bpmn", "sbpmn"):
        yield n, O.diagram_of_tree(tree)
    moves = [("synchronous", "a", 0), ("log", "b", None), ("model", "c", 1), ("silent", None, 2)]
    yield "ali", [O.Alignment(moves)]
    yield "sali", [O.Alignment(moves, Fr(1, 3))]
    yield "exs", [{"trace": 0, "fired_transition": 1}]


@pytest.mark.parametrize(("name", "thing"), list(things()))
def test_files_round_trip(tmp_path, name, thing):
    path = str(tmp_path / f"x.{name}")
    formats.write(thing, path)
    assert formats.read(path, name) == thing and formats.validate(path, name) == "valid"
    (tmp_path / "bad").write_text("neither this\nnor that")
    assert formats.validate(str(tmp_path / "bad"), name).startswith("invalid")
    found, _ = formats.sniffed(formats.text_of(path))
    assert found == name or name in ("sbpmn", "bpmn")
    assert formats.info(thing)["kind"]
    if not isinstance(thing, list):
        assert formats.dot(thing).startswith("digraph") and formats.svg(thing).startswith("<svg")


def test_nets_of_other_notations():
    lola = "PLACE p, q;\nMARKING p: 1;\nTRANSITION a CONSUME p: 1; PRODUCE q: 1;\nTRANSITION b CONSUME q; PRODUCE ;\n"
    assert all_traces(formats.FORMATS["lola"].read(lola)) == {("a", "b")}
    assert all_traces(formats.FORMATS["lola"].read(formats.FORMATS["lola"].write(formats.FORMATS["lola"].read(lola)))) == {("a", "b")}
    powl = O.Powl("partial_order", None, False, False, [O.Powl("activity", x) for x in "abc"], [(0, 1)])
    assert all_traces(powl) == {tuple(t) for t in ("abc", "acb", "cab")}
    choice = O.Powl("choice_graph", None, True, False, [O.Powl("activity", x) for x in "ab"], [(-1, 0), (0, 1), (1, -2)])
    assert all_traces(choice) == {(), ("a", "b")}
    assert str(O.tree_of_powl(O.Powl("partial_order", None, False, False, [O.Powl("activity", x) for x in "ab"], []))) == "concurrent(a, b)"
    assert all_traces(O.diagram_of_net(T.net_of(T.node("xor", [a, b])))) == {("a",), ("b",)}
    graph = O.FollowsGraph(["a"], Fr(1), {"a": Fr(1)}, {"a": Fr(2)}, {("a", "a"): Fr(1)})
    assert M.trace_probability(O.as_model(graph), ("a",)) == Fr(1, 2) * Fr(2, 3)


def test_indexed_nets_step_as_nets_do():
    for tree in [T.node("sequence", [a, b]), T.node("loop", [a, T.node("xor", [b, tau])]), T.node("concurrent", [a, T.node("loop", [b, c])])]:
        net = T.net_of(tree)
        net.add("free", [], [0])
        net.transitions[0].weight = Fr(0)
        fast, states = S.Indexed(net), [net.initial()]
        for state in states:
            sparse = tuple((p, n) for p, n in enumerate(state) if n)
            assert fast.enabled(sparse) == net.enabled(state)
            for t in net.enabled(state):
                after = net.fire(state, t)
                assert fast.fire(sparse, t) == tuple((p, n) for p, n in enumerate(after) if n)
                if len(states) < 200:
                    states.append(after)
        assert fast.initial() == tuple((p, n) for p, n in enumerate(net.initial()) if n)
    assert S.Indexed(S.Net(1, None, [])).initial() is None


def test_nets_of_many_places_are_searched_in_time():
    """Every place was looked at for every step: 20,000 places took over half an hour."""
    language = {(f"a{i}", "b"): Fr(1, 10_000) for i in range(10_000)}
    net = O.net_of_automaton(O.automaton_of_language(language))
    began = time.monotonic()
    assert M.trace_probability(S.Indexed(net), ("a77", "b")) == Fr(1, 10_000)
    assert time.monotonic() - began < 60
