"""All file formats: reading by name, sniffing, validation, information, writing and drawing."""

from __future__ import annotations

import gzip
import sys
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..models import objects as O
from ..models.semantics import Automaton, Net
from ..models.tree import Tree
from . import lines as L
from . import structured as S
from .lines import FormatError


@dataclass(frozen=True)
class Format:
    name: str
    about: str
    read: Callable[[str], object] | None
    write: Callable[[object], str] | None = None


def _language(thing) -> O.Language:
    return thing if isinstance(thing, dict) else {t: Fraction(1, len(thing)) for t in thing}


#: In the order in which files are tried.
FORMATS: dict[str, Format] = {
    f.name: f
    for f in (
        Format("lang", "finite language", L.read_lang, lambda x: L.write_lang(x)),
        Format("slang", "finite stochastic language", L.read_slang, lambda x: L.write_slang(_language(x))),
        Format("spolang", "finite stochastic partially ordered language", L.read_spolang, L.write_spolang),
        Format("dfg", "directly-follows graph", S.read_dfg, S.write_dfg),
        Format("dfm", "directly-follows model", lambda t: L.read_follows(t, False), lambda g: L.write_follows(g, False)),
        Format("sdfm", "stochastic directly-follows model", lambda t: L.read_follows(t, True), lambda g: L.write_follows(g, True)),
        Format("dfa", "deterministic finite automaton", lambda t: S.read_automaton(t, False), lambda a: S.write_automaton(a, False)),
        Format("sdfa", "stochastic deterministic finite automaton", lambda t: S.read_automaton(t, True), lambda a: S.write_automaton(a, True)),
        Format("snfa", "stochastic non-deterministic finite automaton", L.read_snfa, L.write_snfa),
        Format("lpn", "labelled Petri net", lambda t: L.read_net(t, False), lambda n: L.write_net(O.as_net(n), False)),
        Format("slpn", "stochastic labelled Petri net", lambda t: L.read_net(t, True), lambda n: L.write_net(O.as_net(n), True)),
        Format("pnml", "Petri net markup language", S.read_pnml, lambda n: S.write_pnml(O.as_net(n))),
        Format("lola", "net of a model checker", S.read_lola, lambda n: S.write_lola(O.as_net(n))),
        Format("ptree", "process tree", lambda t: S.read_tree(t, False), lambda x: S.write_tree(x, False)),
        Format("ptml", "process tree markup language", S.read_ptml, S.write_ptml),
        Format("sptree", "stochastic process tree", lambda t: S.read_tree(t, True), lambda x: S.write_tree(x, True)),
        Format("powl", "partially ordered workflow language", S.read_powl, S.write_powl),
        Format("sbpmn", "stochastic process diagram", lambda t: S.read_bpmn(t, True), lambda d: S.write_bpmn(d, True)),
        Format("bpmn", "process diagram", lambda t: S.read_bpmn(t, False), lambda d: S.write_bpmn(d, False)),
        Format("ali", "language of alignments", lambda t: L.read_alignments(t, False), lambda a: L.write_alignments(a, False)),
        Format("sali", "stochastic language of alignments", lambda t: L.read_alignments(t, True), lambda a: L.write_alignments(a, True)),
        Format("exs", "executions", S.read_executions, S.write_executions),
        Format("dot", "drawing as text", None, lambda x: dot(x)),
        Format("svg", "drawing", None, lambda x: svg(x)),
    )
}
#: Log formats, read as DataFrames by sources.logs.
LOG_FORMATS = ("xes", "xes.gz", "csv", "ocel", "pandas", "parquet")


def text_of(path: str) -> str:
    """The text of a file, zipped or not; of what comes in where the path is ``-``."""
    data = sys.stdin.buffer.read() if path == "-" else Path(path).read_bytes()
    return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()


def read(path: str, format_name: str | None = None) -> object:
    """Without a name, every format is tried in order, whatever the file is called."""
    return sniffed(text_of(path))[1] if format_name is None else FORMATS[format_name].read(text_of(path))


def sniffed(text: str) -> tuple[str, object]:
    for f in FORMATS.values():
        if f.read:
            try:
                return f.name, f.read(text)
            except (FormatError, ValueError, KeyError, TypeError):
                continue
    raise FormatError("the text is of no known format")


def validate(path: str, format_name: str) -> str:
    try:
        FORMATS[format_name].read(text_of(path))
    except (FormatError, ValueError, KeyError, TypeError) as e:
        return f"invalid: {e}"
    return "valid"


def write(thing: object, path: str, format_name: str | None = None) -> None:
    """Without a name, the longest format name that the file's name ends in decides."""
    name = format_name or max((n for n in FORMATS if path.endswith(f".{n}")), key=len)
    Path(path).write_text(FORMATS[name].write(thing))


def info(thing: object) -> dict[str, object]:
    """What there is to count in an object."""
    out: dict[str, object] = {"kind": type(thing).__name__}
    if isinstance(thing, Net):
        return out | {"places": thing.places, "transitions": len(thing.transitions), "silent": sum(t.label is None for t in thing.transitions), "activities": len(thing.alphabet())}
    if isinstance(thing, Automaton):
        return out | {"states": thing.states, "edges": len(thing.edges), "final": len(thing.final), "activities": len(thing.alphabet())}
    if isinstance(thing, Tree):
        return out | {"leaves": len(thing.leaves()), "activities": len(thing.alphabet())}
    if isinstance(thing, O.FollowsGraph):
        return out | {"activities": len(thing.activities), "edges": len(thing.edges), "starts": len(thing.starts), "ends": len(thing.ends)}
    if isinstance(thing, O.Diagram):
        return out | {"nodes": len(thing.nodes), "flows": len(thing.flows)}
    if isinstance(thing, (dict, set, frozenset)):
        return out | {"traces": len(thing), "events": sum(map(len, thing)), "activities": len({a for t in thing for a in t})} | ({"probability": str(sum(thing.values()))} if isinstance(thing, dict) else {})
    return out | ({"rows": len(thing)} if hasattr(thing, "__len__") else {})


def to_slang(spark: SparkSession, language: O.Language) -> DataFrame:
    """(trace, cnt, n) with whole numbers: probabilities over their common denominator."""
    from math import lcm

    n = lcm(*(p.denominator for p in language.values())) if language else 1
    return spark.createDataFrame([(list(t), int(p * n), n) for t, p in language.items()], "trace array<string>, cnt long, n long")


def from_slang(slang: DataFrame, most: int = 100_000) -> O.Language:
    """For models: a language of at most ``most`` traces comes to the driver; more raise ValueError."""
    rows = slang.select("trace", "cnt", "n").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} variants")
    return {tuple(r.trace): Fraction(r.cnt, r.n) for r in rows}


def _drawn(thing: object) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(name, text, shape) of nodes and (from, to, text) of edges."""
    if isinstance(thing, O.FollowsGraph):
        nodes = [(a, a, "box") for a in thing.activities] + [("in", "", "circle"), ("out", "", "doublecircle")]
        edges = [(a, b, str(w)) for (a, b), w in thing.edges.items()] + [("in", a, str(w)) for a, w in thing.starts.items()] + [(a, "out", str(w)) for a, w in thing.ends.items()]
        return nodes, edges
    if isinstance(thing, O.Diagram):
        return [(n, label or "", "box" if kind == "task" else "circle" if kind.endswith("Event") else "diamond") for n, (kind, label) in thing.nodes.items()], [(a, b, "" if w == 1 else str(w)) for _, a, b, w in thing.flows]
    if isinstance(thing, Tree):
        nodes, edges = [], []

        def add(t: Tree) -> str:
            name = f"n{len(nodes)}"
            nodes.append((name, t.label or t.kind, "circle" if t.children else "box"))
            for c in t.children:
                edges.append((name, add(c), ""))
            return name

        add(thing)
        return nodes, edges
    model = O.as_model(thing)
    if isinstance(model, Automaton):
        return [(str(s), str(s), "doublecircle" if s in model.final else "circle") for s in range(model.states)], [(str(e.source), str(e.target), f"{e.label or ''} {e.weight}".strip()) for e in model.edges]
    nodes = [(f"p{p}", str(model.marking[p] or ""), "circle") for p in range(model.places)] + [(f"t{i}", t.label or "", "box") for i, t in enumerate(model.transitions)]
    return nodes, [e for i, t in enumerate(model.transitions) for e in [*((f"p{p}", f"t{i}", "" if n == 1 else str(n)) for p, n in t.inputs.items()), *((f"t{i}", f"p{p}", "" if n == 1 else str(n)) for p, n in t.outputs.items())]]


def dot(thing: object) -> str:
    nodes, edges = _drawn(thing)
    q = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "\n".join(["digraph {", "rankdir=LR;", *(f"{q(n)} [label={q(t)}, shape={s}];" for n, t, s in nodes), *(f"{q(a)} -> {q(b)} [label={q(t)}];" for a, b, t in edges), "}"]) + "\n"


def svg(thing: object) -> str:
    """Nodes in columns by their distance from the first ones, edges as lines."""
    nodes, edges = _drawn(thing)
    rank, todo = {}, [n for n, *_ in nodes if not any(b == n for _, b, _ in edges)] or [n for n, *_ in nodes[:1]]
    rank.update(dict.fromkeys(todo, 0))
    for n in todo:
        for a, b, _ in edges:
            if a == n and b not in rank:
                rank[b] = rank[n] + 1
                todo.append(b)
    place, used = {}, {}
    for n, *_ in nodes:
        c = rank.get(n, 0)
        place[n] = (80 + 140 * c, 50 + 70 * used.get(c, 0))
        used[c] = used.get(c, 0) + 1
    out = [f'<line x1="{place[a][0]}" y1="{place[a][1]}" x2="{place[b][0]}" y2="{place[b][1]}" stroke="gray"/><text x="{(place[a][0] + place[b][0]) // 2}" y="{(place[a][1] + place[b][1]) // 2 - 4}" font-size="10">{escape(t)}</text>' for a, b, t in edges]
    out += [(f'<rect x="{x - 40}" y="{y - 16}" width="80" height="32" fill="white" stroke="black"/>' if s == "box" else f'<circle cx="{x}" cy="{y}" r="16" fill="white" stroke="black"/>') + f'<text x="{x}" y="{y + 4}" font-size="11" text-anchor="middle">{escape(t)}</text>' for n, t, s in nodes for x, y in [place[n]]]
    w, h = max((x for x, _ in place.values()), default=0) + 80, max((y for _, y in place.values()), default=0) + 50
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}">{"".join(out)}</svg>\n'


