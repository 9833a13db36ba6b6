"""Queries on small models and logs written out here, whose results are known by hand and stand in their SQL, and queries on
the driver's tables that follow from laws of their operators."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import functions as F

from ..models import convert, markov, reduce, semantics, tree
from ..models import discovery as D
from ..models import objects as O
from ..models.semantics import Automaton, Edge, Net
from ..models.tree import TAU, activity, net_of, node
from ..operators import alignment, association, conformance, filters, log, statistics
from ..sources import formats
from .catalogue import as_text, events, query, session_log, session_slang, two
from .commands import _diagram_by_alignments, _markovian
from .files import SMALL_TRACES, SMALL_TREE, likely, member
from .models import _FITS, SUBSET, flower, language, occurrences, rounded, told

A, B, C_ = activity("a"), activity("b"), activity("c")
HALF = Fraction(1, 2)


def net(places: int, marking: tuple[int, ...] | None, *transitions: tuple[str | None, list[int], list[int]]) -> Net:
    out = Net(places, marking, [])
    for label, inputs, outputs in transitions:
        out.add(label, inputs, outputs)
    return out


MODELS = {
    "sequence": net(3, (1, 0, 0), ("a", [0], [1]), ("b", [1], [2])),
    "cycle": net(2, (1, 0), ("a", [0], [1]), ("b", [1], [0])),
    "loop with exit": net(3, (1, 0, 0), ("a", [0], [1]), (None, [1], [0]), ("b", [1], [2])),
    "silent loop with exit": net(3, (1, 0, 0), (None, [0], [1]), (None, [1], [0]), ("b", [1], [2])),
    "producer": net(2, (1, 0), ("a", [0], [0, 1]), ("b", [0], [])),
    "two tokens": net(3, (2, 0, 0), ("a", [0], [1]), ("b", [1], [2])),
    "trap": net(4, (1, 0, 0, 0), ("a", [0], [1]), ("b", [0], [2]), ("c", [2], [3]), ("d", [3], [2])),
    "no marking": net(1, None, ("a", [0], [])),
    "tree": net_of(node("sequence", [A, node("xor", [B, TAU]), node("loop", [C_, TAU])])),
}


def rows(kind: str, expected: dict[str, object], found: Callable[[str], object]) -> Callable:
    """A query of (name, found) whose SQL holds what is expected."""
    say = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT" if kind == "long" else str(v)
    sql = ", ".join(f"('{n}', {say(v)})" for n, v in expected.items())

    def add(name: str) -> None:
        query(f"SELECT * FROM (VALUES {sql}) AS t(name, found)", name)(lambda s, d: told(s, [(n, found(n)) for n in expected], f"name string, found {kind}"))

    return add


rows("boolean", {"sequence": True, "cycle": True, "loop with exit": True, "producer": False, "two tokens": True, "trap": True, "no marking": True, "tree": True}, lambda n: semantics.bounded(MODELS[n]))("model_bounded")
rows("boolean", {"sequence": False, "cycle": False, "loop with exit": True, "silent loop with exit": False, "two tokens": False, "trap": False, "no marking": False, "tree": True}, lambda n: semantics.infinitely_many_traces(MODELS[n]))("model_infinitely_many_traces")
rows("boolean", {"sequence": True, "cycle": False, "loop with exit": True, "trap": True, "no marking": False, "tree": True}, lambda n: semantics.any_traces(MODELS[n]))("model_any_traces")
rows("long", {"sequence": 3, "cycle": 2, "loop with exit": 3, "two tokens": 6, "trap": 4, "no marking": 0}, lambda n: len(semantics.explored(MODELS[n]).states))("model_reachable_states")
rows("long", {"sequence": 0, "cycle": 2, "loop with exit": 0, "silent loop with exit": 0, "trap": 2}, lambda n: len(semantics.explored(MODELS[n]).livelocks()))("model_livelocks")
rows("boolean", {"sequence": False, "cycle": True, "loop with exit": False, "trap": False}, lambda n: semantics.non_decreasing_livelock(MODELS[n], MODELS[n].initial()))("model_non_decreasing_livelock")
TREES = {
    "a then b": node("sequence", [A, B]),
    "a or nothing": node("xor", [A, TAU]),
    "nested sequence": node("sequence", [A, node("sequence", [B, TAU])]),
    "nested choice": node("xor", [node("xor", [A, B]), C_]),
    "loop": node("loop", [A, B]),
    "loop of nothing": node("loop", [TAU, A]),
    "all left out": node("concurrent", [node("xor", [A, TAU]), node("xor", [B, TAU])]),
}
rows("boolean", {"a then b": False, "a or nothing": True, "nested sequence": False, "loop": False, "loop of nothing": True, "all left out": True}, lambda n: tree.empty_traces(TREES[n]))("tree_empty_traces")
rows("string", {"a then b": "sequence(a, b)", "a or nothing": "xor(a, tau)", "nested sequence": "sequence(a, b)", "nested choice": "xor(a, b, c)", "loop": "loop(a, b)"}, lambda n: str(tree.reduced(TREES[n])))("reduce_tree")


def said(found: O.Language) -> str:
    return " ".join(sorted(f"{''.join(t) or '-'}={p}" for t, p in found.items()))


rows("string", {"a then b": "ab=1", "a or nothing": "-=1/2 a=1/2", "nested sequence": "ab=1", "nested choice": "a=1/3 b=1/3 c=1/3", "all left out": "-=1/4 a=1/4 ab=1/8 b=1/4 ba=1/8"}, lambda n: said(convert.language(markov.without_silent(net_of(TREES[n])))))("remove_silent_steps")


def reduction(n: str) -> str:
    before = net_of(TREES[n])
    after = reduce.reduced(before)
    same = {t for t in convert.language(before)} == {t for t in convert.language(after)}
    return f"{'same' if same else 'other'} language, {'fewer' if after.places + len(after.transitions) < before.places + len(before.transitions) else 'as many'} nodes"


rows("string", {"nested sequence": "same language, fewer nodes", "nested choice": "same language, as many nodes"}, reduction)("reduce_net")
TEXTS = {
    "ptree ok": ("ptree", formats.FORMATS["ptree"].write(TREES["a then b"])),
    "ptree cut": ("ptree", formats.FORMATS["ptree"].write(TREES["a then b"])[:-3]),
    "slang ok": ("slang", formats.FORMATS["slang"].write({("a",): Fraction(1)})),
    "slang over 1": ("slang", formats.FORMATS["slang"].write({("a",): Fraction(1), ("b",): HALF})),
    "lpn as slpn": ("slpn", formats.FORMATS["lpn"].write(MODELS["sequence"])),
    "dfa ok": ("dfa", formats.FORMATS["dfa"].write(D.prefix_automaton({("a",)}))),
}


def checked(n: str) -> bool:
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as file:
        file.write(TEXTS[n][1])
        file.flush()
        return formats.validate(file.name, TEXTS[n][0]) == "valid"


rows("boolean", {"ptree ok": True, "ptree cut": False, "slang ok": True, "slang over 1": False, "lpn as slpn": False, "dfa ok": True}, checked)("validate")
rows("string", {"sequence": "3 places, 2 transitions, 0 silent, 2 activities", "silent loop with exit": "3 places, 3 transitions, 2 silent, 1 activities"}, lambda n: "{places} places, {transitions} transitions, {silent} silent, {activities} activities".format(**formats.info(MODELS[n])))("info")


# --- discovery on logs whose models are known ---
def weighted(**counts: int) -> O.Language:
    return {tuple("" if t == "_" else t): Fraction(n, sum(counts.values())) for t, n in ((t.strip("_") or "", n) for t, n in counts.items())}


LOGS = {
    "order and any order": weighted(abc=1, acb=1),
    "choice": weighted(a=1, b=1),
    "repetition": weighted(a=1, aba=1),
    "left out": weighted(ab=1, a=1),
    "nested": weighted(abcd=1, acbd=1, aed=1),
    "own repetition": weighted(a=1, aa=1, aaa=1),
    "once in twenty": weighted(ab=19, c=1),
    "any order of two": weighted(abcd=1, acbd=1),
    "any order, one repeats": weighted(abbcd=1, acbd=1),
}
rows("string", {"order and any order": "sequence(a, concurrent(b, c))", "choice": "xor(a, b)", "repetition": "loop(a, b)", "left out": "sequence(a, xor(tau, b))", "nested": "sequence(a, xor(concurrent(b, c), e), d)", "own repetition": "loop(a, tau)"}, lambda n: str(D.inductive(LOGS[n])))("inductive_miner_known_logs")
rows("string", {"order and any order": "sequence(a, concurrent(b, c))", "choice": "xor(a, b)", "nested": "sequence(a, xor(concurrent(b, c), e), d)"}, lambda n: str(D.inductive(LOGS[n], Fraction(1, 5))))("inductive_miner_infrequent_known_logs")


def in_parallel(n: str) -> bool:
    return any(kind == "parallelGateway" for kind, _ in D.split_miner(LOGS[n]).nodes.values())


rows("boolean", {"any order of two": True, "any order, one repeats": False, "choice": False, "repetition": False}, in_parallel)("split_miner_parallel")


def split(n: str) -> str:
    """Flows with gateways by kind: X exclusive, + parallel."""
    found = D.split_miner(LOGS[n])
    name = {k: label or {"startEvent": "in", "endEvent": "out", "exclusiveGateway": "X", "parallelGateway": "+"}.get(kind, "?") for k, (kind, label) in found.nodes.items()}
    return " ".join(sorted(f"{name[a]}>{name[b]}" for _, a, b, _ in found.flows))


rows("string", {"any order of two": "+>b +>c +>d a>+ b>+ c>+ d>out in>a", "choice": "X>a X>b X>out a>X b>X in>X", "repetition": "X>a X>b X>out a>X b>X in>X"}, split)("split_miner_known_logs")


# --- conversions and discovery with weights, on the driver's tables ---
_LIKELY = "SELECT a.trace, round(coalesce(b.cnt / b.n, 0), 6) AS probability FROM a LEFT JOIN b USING (trace)"
for _name in ("slpn", "snfa"):
    query(_LIKELY, f"convert_{_name}")(lambda s, d, n=_name: likely(s, d, convert.convert(language(s, d, 1), n)))
query("SELECT trace, trace IN (SELECT trace FROM b) AS fits FROM a", "convert_lpn")(lambda s, d: member(s, d, convert.convert(language(s, d, 1), "lpn")))
query(f"SELECT trace, trace IN ({', '.join(repr(t) for t in SMALL_TRACES)}) AS fits FROM slang", "convert_bpmn")(lambda s, d: member(s, d, convert.convert(SMALL_TREE, "bpmn"), None))
query(f"SELECT trace, {_FITS} = len(acts) AS fits FROM slang", "flower_tree")(lambda s, d: member(s, d, D.flower_tree(SUBSET), None))


def leaves(spark, found) -> list[tuple[str, float]]:
    return told(spark, [(x.label, round(float(x.weight), 6)) for x in found.leaves() if x.kind == "activity"], "activity string, weight double")


def tasks(spark, found: O.Diagram):
    return told(spark, [(found.nodes[b][1], round(float(w), 6)) for _, _, b, w in found.flows if found.nodes[b][0] == "task"], "activity string, weight double")


_OCCURRENCES = "SELECT activity, round(sum(cnt) / max(n), 6) AS weight FROM (SELECT unnest(acts) AS activity, cnt, n FROM slang) GROUP BY activity"
ALL = ("click", "error", "purchase", "signup", "view")


query(_OCCURRENCES, "occurrence_tree")(lambda s, d: leaves(s, D.occurrence(D.flower_tree(ALL), occurrences(s, d))))
query(_OCCURRENCES, "occurrence_diagram")(lambda s, d: tasks(s, D.occurrence(O.diagram_of_tree(D.flower_tree(ALL)), occurrences(s, d))))
query("SELECT activity, 1.0 AS weight FROM (SELECT DISTINCT event_type AS activity FROM events)", "uniform_tree")(lambda s, d: leaves(s, D.uniform(D.flower_tree(sorted(occurrences(s, d))))))
query("SELECT activity, 1.0 AS weight FROM (SELECT DISTINCT event_type AS activity FROM events)", "uniform_diagram")(lambda s, d: tasks(s, D.uniform(O.diagram_of_tree(D.flower_tree(sorted(occurrences(s, d)))))))
_DRAWN = "SELECT activity, true AS within, true AS repeats, true AS differs FROM (SELECT DISTINCT event_type AS activity FROM events)"


def drawn(spark, thing, weights: Callable[[object], dict[str, float]]):
    """What holds of random weights: within 0 and 1, the same for the same seed, others for another."""
    x, again, y = (weights(D.randomised(thing, seed)) for seed in (5, 5, 6))
    return told(spark, [(a, 0 < x[a] <= 1, x[a] == again[a], x[a] != y[a]) for a in x], "activity string, within boolean, repeats boolean, differs boolean")


query(_DRAWN, "random_tree")(lambda s, d: drawn(s, D.flower_tree(sorted(occurrences(s, d))), lambda t: {x.label: x.weight for x in t.leaves() if x.kind == "activity"}))
query(_DRAWN, "random_diagram")(lambda s, d: drawn(s, O.diagram_of_tree(D.flower_tree(sorted(occurrences(s, d)))), lambda g: {g.nodes[b][1]: w for _, _, b, w in g.flows if g.nodes[b][0] == "task"}))
query(_DRAWN, "random_net")(lambda s, d: drawn(s, flower(*sorted(occurrences(s, d))), lambda n: {t.label: t.weight for t in n.transitions if t.label}))


@query(_OCCURRENCES)
def alignment_diagram(spark, d):
    return tasks(spark, _diagram_by_alignments(session_slang(spark, d), O.diagram_of_tree(D.flower_tree(ALL))))


# --- alignments on a model with order, choice, concurrency and a step that may be left out ---
def _subsequences(trace: str) -> list[str]:
    acts = trace.split(",")
    return sorted({",".join(c) for k in range(1, len(acts) + 1) for c in itertools.combinations(acts, k)})


def _common(trace: str) -> str:
    """Length of the longest common subsequence with a trace, in SQL: the longest of its subsequences found in order."""
    found = " ".join(f"WHEN ',' || trace || ',' LIKE '%,{s.replace(',', ',%,')},%' THEN {s.count(',') + 1}" for s in sorted(_subsequences(trace), key=lambda s: -s.count(",")))
    return f"CASE {found} ELSE 0 END"


# steps may share the commas between them, so each is doubled before the search
_SPACED = "replace(trace, ',', ',,')"
_COST = "least(" + ", ".join(f"len(acts) + {t.count(',') + 1} - 2 * ({_common(t).replace('trace', _SPACED)})" for t in SMALL_TRACES) + ")"


@query(f"SELECT trace, ({_COST})::BIGINT AS moves_of_one_side FROM slang")
def alignments_small_tree(spark, d):
    """The least number of log and model moves, against the edit distance without replacements to the nearest trace."""
    found = alignment.align(session_slang(spark, d), net_of(SMALL_TREE))
    return found.select(as_text(), F.size(F.filter("moves", lambda m: m["kind"].isin("log", "model"))).cast("long").alias("moves_of_one_side"))


@query(f"SELECT round(sum(CASE WHEN {_COST} = 0 THEN cnt ELSE 0 END) / sum(cnt), 6) AS fitting FROM slang")
def fitting_traces_small_tree(spark, d):
    return rounded(alignment.fitting_traces(alignment.align(session_slang(spark, d), net_of(SMALL_TREE))), "fitting")


# --- partial orders ---
@query("SELECT * FROM (VALUES ('same', 1.0), ('one order of two', 1.0), ('disjoint', 0.0), ('half apart', 0.75)) AS t(name, value)")
def conformance_emsc_orders(spark, d):
    one, other = [("a", ()), ("b", (0,))], [("c", ()), ("d", (0,))]
    free, near = [("a", ()), ("b", ())], [("a", ()), ("c", (0,))]
    order = lambda *xs: [O.Order(x, Fraction(1, len(xs))) for x in xs]
    pairs = {"same": (order(one), order(one)), "one order of two": (order(free), order(one)), "disjoint": (order(one), order(other)), "half apart": (order(one, one), order(one, near))}
    return told(spark, [(n, round(statistics.earth_movers_orders(x, y), 6)) for n, (x, y) in pairs.items()], "name string, value double")


@query("SELECT 300::BIGINT AS runs, 1.0 AS probability, true AS first_is_first, true AS middle_in_any_order")
def sample_orders(spark, d):
    """What holds of every run of the small tree's diagram."""
    found = statistics.sample_orders(spark, O.as_model(O.diagram_of_tree(SMALL_TREE)), 300)
    at = lambda a: F.array_position(F.col("events.activity"), a) - 1
    before = lambda a: F.get("events.predecessors", at(a))
    return found.agg(
        F.count("*").alias("runs"),
        F.round(F.sum("probability"), 6).alias("probability"),
        F.bool_and((F.size(before("click")) == 1) & (F.size(before("purchase")) == 1)).alias("first_is_first"),
        F.bool_and(~F.array_contains(before("click"), at("purchase").cast("int")) & ~F.array_contains(before("purchase"), at("click").cast("int"))).alias("middle_in_any_order"),
    )


@query("SELECT 500::BIGINT AS drawn, 500::BIGINT AS known, true AS repeats")
def sample_model_laws(spark, d):
    """Every walk is a trace of the model's language, and the same seed gives the same sample."""
    own, model = session_slang(spark, d), O.automaton_of_language(language(spark, d))
    x, again = (statistics.sample_model(spark, model, 500, seed=3) for _ in range(2))
    known = x.join(own.select("trace"), "trace", "left_semi").agg(F.sum("cnt").alias("known"))
    same = x.join(again.withColumnRenamed("cnt", "other"), "trace", "full").agg(F.bool_and(F.coalesce(F.col("cnt") == F.col("other"), F.lit(False))).alias("repeats"))
    return x.agg(F.sum("cnt").alias("drawn")).join(known).join(same)


# --- transport with a known plan ---
_TWO = {"view,click": 3, "purchase": 2}


@query("""SELECT round(1 - sum(least(greatest(0.6 - before, 0), p) * d1 + (p - least(greatest(0.6 - before, 0), p)) * d2), 6) AS value FROM (
  SELECT *, coalesce(sum(p) OVER (ORDER BY d1 - d2, trace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT trace, cnt / n AS p, levenshtein(code, 'vc') / greatest(length(code), 2) AS d1, levenshtein(code, 'p') / greatest(length(code), 1) AS d2 FROM code))""")
def conformance_emsc_two_traces(spark, d):
    """Against a language of two traces the best transport fills the first by the difference of the two distances."""
    other = told(spark, [(t.split(","), n, 5) for t, n in _TWO.items()], "trace array<string>, cnt long, n long")
    return rounded(statistics.earth_movers(session_slang(spark, d), other), "value")


@query("SELECT round(1 - sum(cnt / n * levenshtein(code, 'vcp') / greatest(length(code), 3)), 6) AS value FROM code")
def conformance_emsc_one_trace(spark, d):
    other = told(spark, [(["view", "click", "purchase"], 1, 1)], "trace array<string>, cnt long, n long")
    return rounded(statistics.earth_movers(session_slang(spark, d), other), "value")


@query("SELECT true AS same_is_one, true AS symmetric, true AS at_least_unit")
def conformance_emsc_laws(spark, d):
    """A language is at no distance from itself, both ways are as far, and no further than by unit distances."""
    a, b = two(spark, d)
    value = lambda df: df.first()[0]
    there, back, own = value(statistics.earth_movers(a, b)), value(statistics.earth_movers(b, a)), value(statistics.earth_movers(a, a))
    unit = value(conformance.unit_earth_movers(conformance.probed(a, b)))
    return told(spark, [(abs(own - 1) < 1e-9, abs(there - back) < 1e-9, there >= unit - 1e-9)], "same_is_one boolean, symmetric boolean, at_least_unit boolean")


@query("SELECT trace, len(acts)::INT AS moves FROM slang")
def explain_trace_by_itself(spark, d):
    """A trace of the model is explained by its own path: no move of one side, and an edge per event."""
    own = session_slang(spark, d)
    found = alignment.explain(own, O.automaton_of_language(language(spark, d)))
    return found.select(as_text(), F.size(F.filter("moves", lambda m: m["kind"] == "synchronous")).alias("moves"))


_MARKOV = """SELECT round(1 - sum(greatest(0, pa - pb)), 6) AS value FROM (SELECT x.p AS pa, coalesce(y.p, 0) AS pb FROM
  (SELECT t, sum(cnt) / sum(sum(cnt)) OVER () AS p FROM (SELECT cnt, unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1])) AS t FROM (SELECT list_concat(['+'], acts, ['-']) AS t, cnt FROM a)) GROUP BY t) x LEFT JOIN
  (SELECT t, sum(cnt) / sum(sum(cnt)) OVER () AS p FROM (SELECT cnt, unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1])) AS t FROM (SELECT list_concat(['+'], acts, ['-']) AS t, cnt FROM b)) GROUP BY t) y USING (t))"""


@query(_MARKOV)
def markovian_uemsc_of_model(spark, d):
    return rounded(_markovian(session_slang(spark, d, 0), O.automaton_of_language(language(spark, d, 1)), 2, "uemsc"), "value")


@query("SELECT case_id, trace FROM log WHERE len(list_filter(acts, lambda x: x = 'click')) >= 2")
def filter_retain(spark, d):
    return filters.retain(session_log(spark, d), F.size(F.filter("trace", lambda x: x == "click")) >= 2).select("case_id", as_text())


_PER_USER = "(SELECT list_aggregate(list_transform(acts, lambda x: x[1]), 'string_agg', '') AS code, worth, len(acts) AS size, since FROM (SELECT list(event_type ORDER BY ts, event_id) AS acts, sum(value) AS worth, epoch(min(ts)) AS since FROM events GROUP BY user_id))"


@query(" UNION ALL ".join(f"SELECT '{a}' AS attribute, round(corr(abs(s.{a} - t.{a}), levenshtein(s.code, t.code) / greatest(length(s.code), length(t.code))), 4) AS association FROM {_PER_USER} s, {_PER_USER} t" for a in ("worth", "size", "since")))
def association_all(spark, d):
    """Every attribute of users' cases that has an order: numbers and times."""
    each = events(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    told_ = each.groupBy("user_id").agg(F.sum("value").alias("worth"), F.count("*").alias("size"), F.min("ts").alias("since"))
    own = log.to_log(each, "user_id", "event_type", ["ts", "event_id"])
    own = own.join(told_, own.case_id == told_.user_id).select("case_id", "trace", "worth", "size", "since")
    return association.all_attributes(own).select("attribute", F.round("association", 4).alias("association"))
