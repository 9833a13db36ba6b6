"""Every command of the tree runs on small files of the kinds it takes."""

import math
from fractions import Fraction as Fr

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.__main__ import loaded, main, prepared, shown
from tracemill.models import convert, objects, tree
from tracemill.operators import alignment
from tracemill.plans.commands import COMMANDS, documentation
from tracemill.sources import formats

LANGUAGE = {("a", "b"): Fr(1, 2), ("a", "c"): Fr(1, 4), ("a",): Fr(1, 4)}
TREE = tree.node("sequence", [tree.activity("a"), tree.node("xor", [tree.activity("b"), tree.activity("c"), tree.TAU])])
VALUES = {"number": "2", "fraction": "1/2"}
TEXTS = {"filter traces length": ["<"], "filter traces event activity": ["any", "b"], "probability trace": ["a,b"], "probability trace-of-model": ["a,b"], "probability explain-trace": ["a,b"], "conformance markovian": ["uemsc"], "conformance markovian-of-model": ["hsc"], "association trace-attribute": ["size"], "association trace-attribute-categorical": ["half"], "test log-categorical-attribute": ["half"]}


AB, AC, A = ("a", "b"), ("a", "c"), ("a",)
THIRD = Fr(1, 3)
#: By hand: the language has ab 1/2, ac 1/4, a 1/4, of 20 cases; the tree's traces a, ab and ac have 1/3 each. Rows are sorted.
EXPECTED = {
    "analyse all-traces": [((AB), 10, 20), (A, 5, 20), (AC, 5, 20)],
    "analyse all-traces-of-model": [(THIRD, A), (THIRD, AB), (THIRD, AC)],
    "analyse completeness": [(1.0,)],
    "analyse coverage": [(AB, 10, 20)],
    "analyse coverage-of-model": [(THIRD, A), (THIRD, AB)],
    "analyse directly-follows-edge-difference": 0,
    "analyse directly-follows-edge-difference-no-frequencies": 0,
    "analyse entropy": [(1.5,)],
    "analyse entropy-of-model": math.log2(3),
    "analyse medoid": [(AB, 0.25), (A, 0.375)],
    "analyse minimum-probability-traces": [(AB, 10, 20)],
    "analyse minimum-probability-traces-of-model": [],
    "analyse mode": [(AB, 10, 20)],
    "analyse mode-of-model": [(THIRD, A)],
    "analyse most-likely-traces": [(AB, 10, 20), (A, 5, 20)],
    "analyse most-likely-traces-of-model": [(THIRD, A), (THIRD, AB)],
    "analyse variety": [(0.3125,)],
    "analyse-non-stochastic activities": ["a", "b", "c"],
    "analyse-non-stochastic any-traces": True,
    "analyse-non-stochastic bounded": True,
    "analyse-non-stochastic empty-traces": False,
    "analyse-non-stochastic infinitely-many-traces": False,
    "analyse-non-stochastic medoid": [(A, 1.0), (AB, 1.0)],
    "analyse-non-stochastic timestamps-ordered": [(True,)],
    **{f"conformance {n}": [(1.0,)] for n in ("unit-earth-movers", "hellinger", "chi-squared", "jensen-shannon", "earth-movers", "gain-recall", "markovian")},
    "conformance unit-earth-movers-of-model": [(5 / 6,)],
    "conformance hellinger-of-model": [(1 - math.sqrt(((0.5**0.5 - 3**-0.5) ** 2 + 2 * (0.5 - 3**-0.5) ** 2) / 2),)],
    "conformance chi-squared-of-model": [(1 - ((1 / 6) ** 2 / (5 / 6) + 2 * (1 / 12) ** 2 / (7 / 12)) / 2,)],
    "conformance jensen-shannon-of-model": [(1 - math.sqrt(sum(p * math.log2(2 * p / (p + q)) + q * math.log2(2 * q / (p + q)) for p, q in ((0.5, 1 / 3), (0.25, 1 / 3), (0.25, 1 / 3))) / 2),)],
    "conformance entropic-relevance": [(1.5,)],
    "conformance entropic-relevance-of-model": [(math.log2(3),)],
    "conformance gain-precision": [(1.5 / math.log2(3),)],
    "conformance-non-stochastic escaping-edges-precision": [(1.0,)],
    "conformance-non-stochastic fitting-traces": [(1.0,)],
    "conformance-non-stochastic trace-fitness": [(1.0,)],
    "discover directly-follows-graph": [("a", "b", 10), ("b", None, 10), (None, "a", 10)],
    "probability log": [(1.0,)],
    "probability log-of-model": [(1.0,)],
    "probability trace": [(0.5,)],
    "probability trace-of-model": THIRD,
    "test bootstrap-test": [(1.0, 0.0, False)],
    "test permutation-test": [(1.0, 1.0, False)],
}
#: What conversions and discoveries give: the traces of the model, whatever its form.
TRACES = {
    **{f"convert {n}": {A, AB, AC} for n in ("bpmn", "lang", "lpn", "sdfa", "slang", "slpn", "snfa")},
    **{f"discover {k} {n}": {A, AB, AC} for k in ("occurrence", "random", "uniform") for n in ("sbpmn", "slpn", "sptree")},
    "discover alignments slpn": {A, AB, AC},
    "discover alignments sbpmn": {A, AB, AC},
    "discover-non-stochastic inductive-miner": {A, AB, AC},
    "discover-non-stochastic inductive-miner-infrequent": {AB, AC},
    "discover-non-stochastic prefix-tree dfa": {A, AB, AC},
    "discover-non-stochastic prefix-tree ptree": {A, AB, AC},
    "discover-non-stochastic trace-model": {A, AB, AC},
    "reduce petri-net": {A, AB, AC},
    "reduce process-tree": {A, AB, AC},
}


def plain(x):
    """Lists, rows and arrays as tuples, so that they can be compared and sorted."""
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def near(found, want):
    if isinstance(want, (list, tuple)):
        return len(found) == len(want) and all(map(near, found, want))
    return found == pytest.approx(want) if isinstance(want, float) else found == want


@pytest.fixture(scope="module")
def inputs(spark):
    slang = formats.to_slang(spark, LANGUAGE).withColumn("cnt", F.col("cnt") * 5).withColumn("n", F.col("n") * 5)
    log = slang.selectExpr("explode(sequence(1L, cnt)) AS i", "trace").withColumn("case_id", F.monotonically_increasing_id()).withColumn("size", F.col("i").cast("double")).withColumn("half", F.when(F.col("i") % 2 == 0, "x").otherwise("y")).drop("i").cache()
    events = log.select(F.col("case_id").cast("string").alias("case_id"), F.posexplode("trace").alias("pos", "activity")).withColumn("ts", F.timestamp_seconds(F.col("pos"))).withColumn("resource", F.lit("r"))
    model = objects.as_model(TREE)
    return {"slang": slang, "log": log, "lang": log.select("trace").distinct(), "events": events, "model": model, "net": model, "tree": TREE, "diagram": objects.diagram_of_tree(TREE), "graph": objects.graph_of_language(LANGUAGE), "alignments": alignment.align(slang, model), "any": LANGUAGE}


@pytest.mark.parametrize("name", sorted(COMMANDS.keys() - {"validate", "conformance earth-movers-partially-ordered"}))
def test_runs(inputs, name):
    texts = iter(TEXTS.get(name, []))
    args = [next(texts) if t == "text" else VALUES[t] if t == "number" else Fr(1, 2) if t == "fraction" else inputs[t] for t in COMMANDS[name].takes]
    found = COMMANDS[name].run(*args)
    if isinstance(found, DataFrame):
        found = found.collect()
    assert found is not None and shown(found) != ""
    if name in EXPECTED:
        want, found = EXPECTED[name], [plain(r) for r in found] if isinstance(found, list) and found and isinstance(found[0], tuple) else found
        order = lambda rows: sorted(rows, key=lambda r: [str(x) for x in r])
        assert near(order(found), order(want)) if isinstance(want, list) else near(found, want)
    if name in TRACES:
        assert set(convert.language(found)) == TRACES[name]


def test_standard_input(spark, monkeypatch, capsys):
    import io
    from types import SimpleNamespace

    monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO(formats.FORMATS["slang"].write(LANGUAGE).encode())))
    assert main(["analyse", "entropy", "-"]) == 0 and "1.5" in capsys.readouterr().out


def test_what_is_counted_is_shown(spark):
    assert shown({"kind": "Net", "places": 3}) == "kind: Net\nplaces: 3"


def test_whole_results_are_shown(spark):
    assert shown(spark.range(5000)).count("id") == 5000


def test_files(spark, tmp_path, capsys):
    paths = {n: str(tmp_path / f"x.{n}") for n in ("slang", "ptree", "xes")}
    formats.write(LANGUAGE, paths["slang"])
    formats.write(TREE, paths["ptree"])
    (tmp_path / "x.xes").write_text('<log><trace><event><string key="concept:name" value="a"/></event></trace></log>')
    for args, want in (
        (["conformance", "unit-earth-movers", paths["slang"], paths["slang"]], "1.0"),
        (["probability", "trace-of-model", paths["ptree"], "a,b"], "1/3"),
        (["analyse", "mode", paths["xes"]], "['a']"),
        (["validate", paths["ptree"], "ptree"], "valid"),
        (["convert", "slpn", paths["ptree"]], "stochastic labelled Petri net"),
        (["conformance", "earth-movers-partially-ordered", paths["slang"], paths["slang"]], "1.0"),
    ):
        assert main(args) == 0 and want in capsys.readouterr().out
    assert main(["nothing"]) == 1 and main(["info"]) == 1
    assert "conformance unit-earth-movers" in documentation()
    assert loaded(spark, "log", paths["slang"]).count() == 4 and prepared(spark, "graph", LANGUAGE).starts == {"a": 1}
    with pytest.raises(formats.FormatError):
        formats.sniffed("nothing known")


def test_conversions_keep_the_language():
    for target in ("slang", "lpn", "slpn", "snfa", "sdfa"):
        assert convert.language(convert.convert(LANGUAGE, target)) == LANGUAGE
    assert convert.convert(objects.as_model(LANGUAGE), "sdfm") == objects.FollowsGraph(["a", "b", "c"], Fr(0), {"a": Fr(1)}, {"a": Fr(1, 4), "b": Fr(1, 2), "c": Fr(1, 4)}, {("a", "b"): Fr(1, 2), ("a", "c"): Fr(1, 4)})
    assert convert.language(convert.convert(TREE, "bpmn")) == {("a", "b"): Fr(1, 3), ("a", "c"): Fr(1, 3), ("a",): Fr(1, 3)}
    silent = convert.determinised(objects.as_model(TREE))
    assert silent.deterministic() and convert.language(silent) == {("a", "b"): Fr(1, 3), ("a", "c"): Fr(1, 3), ("a",): Fr(1, 3)}
