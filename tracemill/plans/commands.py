"""The command tree: every command with what it takes and what it gives, and a way to run it on files.

Inputs: ``slang`` a stochastic language (a log file counts as one), ``lang`` a set of traces, ``log`` a log DataFrame,
``events`` an event DataFrame, ``model`` anything with traces, ``net``, ``tree``, ``diagram``, ``graph``, ``alignments``,
``any`` object, ``number``, ``fraction``, ``text``. Languages are DataFrames ``(trace, cnt, n)`` where the command works on
DataFrames, and are converted where it works on models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import convert as C
from ..models import discovery as D
from ..models import kernels as K
from ..models import markov as M
from ..models import objects as O
from ..models import reduce as R
from ..models import semantics as S
from ..models import tree as T
from ..operators import alignment, analysis, association, conformance, dfg, filters, log, probability, sampling, statistics
from ..sources import formats


@dataclass(frozen=True)
class Command:
    name: str
    takes: tuple[str, ...]
    run: Callable
    about: str


COMMANDS: dict[str, Command] = {}


def add(name: str, takes: str, about: str, run: Callable) -> None:
    COMMANDS[name] = Command(name, tuple(takes.split()), run, about)


def small(df: DataFrame) -> O.Language:
    return formats.from_slang(df)


def tables(df: DataFrame, rows: list[tuple[Fraction, tuple[str, ...]]]) -> DataFrame:
    return formats.to_slang(df.sparkSession, {t: p for p, t in rows})


# --- analyse ---
add("analyse all-traces", "slang", "all traces of a stochastic language", lambda a: a)
add("analyse all-traces-of-model", "model", "all traces of a stochastic model", lambda m: M.minimum_probability(m, Fraction(0)))
add("analyse completeness", "log", "estimated share of the variants that were seen", analysis.completeness)
add("analyse coverage", "slang fraction", "likeliest traces that cover a share", lambda a, q: analysis.coverage(a, float(q)))
add("analyse coverage-of-model", "model fraction", "the same of a model", M.coverage)
add("analyse directly-follows-edge-difference", "graph graph", "summed difference of all weights", lambda a, b: _edges(a, b, True))
add("analyse directly-follows-edge-difference-no-frequencies", "graph graph", "entries that only one graph has", lambda a, b: _edges(a, b, False))
add("analyse entropy", "slang", "entropy in bits", analysis.entropy)
add("analyse entropy-of-model", "model", "entropy of a deterministic model in bits", M.entropy)
add("analyse medoid", "slang number", "traces nearest to all others", lambda a, k: analysis.medoid(a, int(k)))
add("analyse minimum-probability-traces", "slang fraction", "traces at least as likely", lambda a, q: analysis.minimum_probability(a, float(q)))
add("analyse minimum-probability-traces-of-model", "model fraction", "the same of a model", M.minimum_probability)
add("analyse mode", "slang", "the likeliest trace", analysis.mode)
add("analyse mode-of-model", "model", "the same of a model", lambda m: M.most_likely(m, 1))
add("analyse most-likely-traces", "slang number", "the k likeliest traces", lambda a, k: analysis.most_likely(a, int(k)))
add("analyse most-likely-traces-of-model", "model number", "the same of a model", lambda m, k: M.most_likely(m, int(k)))
add("analyse variety", "slang", "expected edit distance of two traces, each pair once", analysis.variety)

# --- analyse-non-stochastic ---
add("analyse-non-stochastic activities", "any", "the activities", lambda x: sorted(_alphabet(x)))
add("analyse-non-stochastic any-traces", "model", "whether there is a trace", S.any_traces)
add("analyse-non-stochastic bounded", "model", "whether there are finitely many states", S.bounded)
add("analyse-non-stochastic cluster", "slang number", "k medoids", lambda a, k: statistics.cluster(a, int(k)))
add("analyse-non-stochastic executions", "events model", "a row per fired transition, with resource utilisation", lambda e, m: alignment.with_utilisation(alignment.executions(e, m)))
add("analyse-non-stochastic empty-traces", "tree", "whether the empty trace is in the language", T.empty_traces)
add("analyse-non-stochastic infinitely-many-traces", "model", "whether there are infinitely many traces", S.infinitely_many_traces)
add("analyse-non-stochastic medoid", "slang number", "traces nearest to all others, each counting once", lambda a, k: analysis.medoid(a, int(k), weighted=False))
add("analyse-non-stochastic timestamps-ordered", "events", "whether times never decrease within a case", lambda e: analysis.timestamps_ordered(e, "case_id", "ts", ["pos"]))

# --- association and tests ---
add("association trace-attribute", "log text", "association of a numeric attribute with the traces", association.numeric)
add("association trace-attribute-categorical", "log text", "the same of a categorical attribute", association.categorical)
add("association all-trace-attributes", "log", "all attributes: numbers, times, texts and booleans", association.all_attributes)
add("test log-categorical-attribute", "log text number", "whether cases of a value are nearer to each other", lambda x, a, k: statistics.categorical_test(x, a, int(k)))
add("test bootstrap-test", "slang slang number", "whether two languages differ, by resampling the first", lambda a, b, k: statistics.bootstrap_test(a, b, int(k)))
add("test permutation-test", "slang slang number", "whether two languages differ, by re-splitting their pool", lambda a, b, k: statistics.permutation_test(a, b, int(k)))
add("test permutation-test-log-model", "slang model number", "whether a log differs from a model", lambda a, m, k: statistics.permutation_test_model(a, m, int(k)))

# --- conformance ---
MEASURES = {"unit-earth-movers": conformance.unit_earth_movers, "hellinger": conformance.hellinger, "chi-squared": conformance.chi_squared, "jensen-shannon": conformance.jensen_shannon}
for _name, _f in MEASURES.items():
    add(f"conformance {_name}", "slang slang", f"{_name} conformance of two languages", lambda a, b, f=_f: f(conformance.probed(a, b)))
    add(f"conformance {_name}-of-model", "slang model", f"{_name} conformance of a log and a model", lambda a, m, f=_f: f(alignment.probed(a, m)))
    add(f"conformance {_name}-sample", "slang slang number", "the same on samples", lambda a, b, k, f=_f: f(conformance.probed(sampling.sample_traces(a, int(k)), sampling.sample_traces(b, int(k), 1))))
add("conformance earth-movers", "slang slang", "earth movers' conformance", statistics.earth_movers)
add("conformance earth-movers-sample", "slang slang number", "the same on samples", lambda a, b, k: statistics.earth_movers(sampling.sample_traces(a, int(k)), sampling.sample_traces(b, int(k), 1)))
add("conformance earth-movers-partially-ordered", "any any", "earth movers' conformance of partially ordered languages", lambda a, b: statistics.earth_movers_orders(_orders(a), _orders(b)))
add("conformance entropic-relevance", "slang slang", "bits per trace", conformance.entropic_relevance)
add("conformance entropic-relevance-of-model", "slang model", "the same against a model", lambda a, m: conformance.relevance_of(alignment.probed(a, m), a))
add("conformance markovian", "slang slang number text", "conformance of k-grams by uemsc, hsc or cssc", lambda a, b, k, m: conformance.markovian(a, b, int(k), m))
add("conformance markovian-of-model", "slang model number text", "the same against a model", lambda a, m, k, f: _markovian(a, m, int(k), f))
add("conformance gain-precision", "slang model", "common information over the model's", lambda a, m: conformance.gain_precision(alignment.probed(a, m), M.entropy(m)))
add("conformance gain-recall", "slang model", "common information over the log's", lambda a, m: conformance.gain_recall(alignment.probed(a, m)))
add("conformance-non-stochastic alignments", "slang model", "cheapest alignments of a stochastic language", alignment.align)
add("conformance-non-stochastic set-alignments", "lang model", "cheapest alignments of a set of traces", alignment.align)
add("conformance-non-stochastic escaping-edges-precision", "alignments model", "edges taken over edges enabled", alignment.escaping_edges_precision)
add("conformance-non-stochastic fitting-traces", "alignments", "share of the traces that fit", alignment.fitting_traces)
add("conformance-non-stochastic trace-fitness", "alignments", "expected share of synchronous moves", alignment.trace_fitness)

# --- convert ---
for _name, _about in {"bpmn": "a diagram", "log": "a log", "lpn": "a net", "lang": "a finite language", "slang": "a stochastic language", "sdfa": "a deterministic automaton", "slpn": "a stochastic net", "sdfm": "a follows model", "snfa": "an automaton"}.items():
    add(f"convert {_name}", "any", f"to {_about}", lambda x, n=_name: C.convert(x, n))

# --- discover ---
add("discover directly-follows-graph", "log fraction", "a follows graph that keeps a share of the traces", lambda x, q: dfg.dfg_with_fitness(x, float(q)))
for _kind in ("slpn", "sptree", "sbpmn"):
    _takes = {"slpn": "net", "sptree": "tree", "sbpmn": "diagram"}[_kind]
    add(f"discover occurrence {_kind}", f"slang {_takes}", "weights by expected occurrences", lambda a, m: D.occurrence(m, _occurrences(a)))
    add(f"discover random {_kind}", _takes, "random weights", D.randomised)
    add(f"discover uniform {_kind}", _takes, "weights of one", D.uniform)
add("discover alignments slpn", "slang net", "weights by expected firings", lambda a, n: _by_alignments(a, n))
add("discover alignments sbpmn", "slang diagram", "weights by expected firings of the tasks", lambda a, d: _diagram_by_alignments(a, d))
add("discover-non-stochastic flower dfa", "any", "any order of the activities", lambda x: D.flower_automaton(_alphabet(x)))
add("discover-non-stochastic flower ptree", "any", "the same as a tree", lambda x: D.flower_tree(_alphabet(x)))
add("discover-non-stochastic prefix-tree dfa", "lang", "a trie of the traces", lambda x: D.prefix_automaton(_set(x)))
add("discover-non-stochastic prefix-tree ptree", "lang", "the same as a tree", lambda x: D.prefix_tree(_set(x)))
add("discover-non-stochastic trace-model", "lang", "a choice of the traces", lambda x: D.trace_tree(_set(x)))
add("discover-non-stochastic inductive-miner", "slang", "a tree that fits all traces", lambda a: D.inductive(small(a)))
add("discover-non-stochastic inductive-miner-infrequent", "slang fraction", "a tree without infrequent behaviour", lambda a, q: D.inductive(small(a), Fraction(q)))
add("discover-non-stochastic split-miner", "slang fraction fraction", "a diagram", lambda a, e, n: D.split_miner(small(a), Fraction(e), Fraction(n)))

# --- filter, sample, probability, reduce, information ---
add("filter traces length", "log text number", "removes by length: <, <=, >, >=, =, <>", lambda x, c, k: filters.remove_length(x, c, int(k)))
add("filter traces empty", "log", "removes empty traces", filters.remove_empty)
add("filter traces event activity", "log text text", "removes by any, all, none, start or end", filters.remove_activity)
add("sample traces", "slang number", "k traces with replacement", lambda a, k: sampling.sample_traces(a, int(k)))
add("sample traces-of-model", "model number", "k random walks", lambda m, k: statistics.sample_model(_session(), m, int(k)))
add("sample partially-ordered-traces", "diagram number", "k random runs as partial orders", lambda d, k: statistics.sample_orders(_session(), O.as_model(d), int(k)))
add("sample folds", "log number number", "one of n folds", lambda x, n, k: sampling.folds(x, int(n), int(k)))
add("probability log", "slang lang", "summed probability of a set of traces", probability.of_log)
add("probability log-of-model", "lang model", "the same of a model", lambda a, m: alignment.probabilities(a.select("trace").distinct(), m).agg(F.sum("pb").alias("probability")))
add("probability trace", "slang text", "probability of a trace, given with commas", lambda a, t: probability.of_trace(a, _trace(t)))
add("probability trace-of-model", "model text", "the same of a model", lambda m, t: M.trace_probability(m, _trace(t)))
add("probability explain-trace", "model fraction text", "the likeliest explanation of a trace", lambda m, q, t: [O.Alignment(K.explain(m, _trace(t), Fraction(q)))])
add("reduce petri-net", "net", "a smaller net of the same language", R.reduced)
add("reduce process-tree", "tree", "a smaller tree of the same language", T.reduced)
add("info", "any", "what there is to count", formats.info)
add("validate", "text text", "whether a file is of a format", formats.validate)
add("visualise text", "any", "a drawing as text", formats.dot)
add("visualise graph", "any", "a drawing", formats.svg)
add("itself documentation commands", "", "this list", lambda: documentation())
add("itself documentation file-handlers", "", "the file formats", lambda: "\n".join(f"{f.name}: {f.about}" for f in formats.FORMATS.values()))


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def _trace(text: str) -> list[str]:
    return text.split(",") if text else []


def _set(x) -> set:
    return {tuple(r.trace) for r in log.lang(x).collect()} if isinstance(x, DataFrame) else set(x)


def _alphabet(x) -> set[str]:
    if isinstance(x, DataFrame):
        return {r.activity for r in log.activities(x).collect()}  # one row per activity
    if isinstance(x, (dict, set, frozenset)):
        return {a for t in x for a in t}
    return set(x.alphabet()) if hasattr(x, "alphabet") else set(x.activities) if hasattr(x, "activities") else set(O.as_net(x).alphabet())


def _orders(x) -> list[O.Order]:
    if isinstance(x, dict):
        return [O.Order([(a, (i - 1,) if i else ()) for i, a in enumerate(t)], p) for t, p in x.items()]
    return x


def _occurrences(a: DataFrame) -> dict[str, Fraction]:
    rows = a.select(F.explode("trace").alias("a"), "cnt", "n").groupBy("a").agg(F.sum("cnt").alias("c"), F.max("n").alias("n")).collect()
    return {r.a: Fraction(r.c, r.n) for r in rows}


def _fired(a: DataFrame, model) -> dict[int, Fraction]:
    rows = alignment.align(a, model).select(F.explode("moves").alias("m"), "cnt", "n").where("m.kind != 'log'").groupBy("m.transition").agg(F.sum("cnt").alias("c"), F.max("n").alias("n")).collect()  # one row per transition
    return {r.transition: Fraction(r.c, r.n) for r in rows}


def _by_alignments(a: DataFrame, net: S.Net) -> S.Net:
    fired = _fired(a, net)
    return D.weighted_net(net, lambda i, _: fired.get(i, Fraction(0)))


def _diagram_by_alignments(a: DataFrame, d: O.Diagram) -> O.Diagram:
    """A flow weighs as often as what it leads to fires after it; for a task that is how often the task does."""
    net, fired = O.net_of_diagram(d), _fired(a, O.net_of_diagram(d))
    into = [Fraction(0)] * len(d.flows)
    for i, t in enumerate(net.transitions):
        for p in t.outputs:
            if p < len(d.flows):
                into[p] += fired.get(i, Fraction(0))
    return O.Diagram(dict(d.nodes), [(f, x, y, w) for (f, x, y, _), w in zip(d.flows, into, strict=True)])


def _edges(a: O.FollowsGraph, b: O.FollowsGraph, weights: bool) -> Fraction | int:
    flat = lambda g: {("", ""): g.empty} | {("", x): w for x, w in g.starts.items()} | {(x, ""): w for x, w in g.ends.items()} | g.edges
    x, y = flat(a), flat(b)
    each = [(x.get(k, Fraction(0)), y.get(k, Fraction(0))) for k in x.keys() | y.keys()]
    return sum((abs(p - q) for p, q in each), Fraction(0)) if weights else sum((p != 0) != (q != 0) for p, q in each)


def _markovian(a: DataFrame, model, k: int, measure: str) -> DataFrame:
    rows = [(list(g), float(p), 1.0) for g, p in M.abstraction(model, k).items()]
    grams = a.sparkSession.createDataFrame(rows, "trace array<string>, cnt double, n double")
    return conformance.MEASURES[measure](conformance.probed(conformance.kgrams(a, k), grams))


def documentation() -> str:
    return "\n".join(f"{c.name} {' '.join(f'<{t}>' for t in c.takes)}: {c.about}" for c in COMMANDS.values())
