"""JSON and XML models, and the indented tree formats."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from fractions import Fraction

from ..models.objects import Diagram, FollowsGraph, Powl
from ..models.semantics import ONE, ZERO, Automaton, Edge, Net, Transition
from ..models.tree import OPERATORS, Tree
from .lines import FormatError, fraction


def loaded(text: str) -> dict:
    try:
        found = json.loads(text)
    except ValueError as e:
        raise FormatError(str(e)) from None
    if not isinstance(found, dict):
        raise FormatError("expected an object")
    return found


def need(d: dict, key: str):
    if key not in d:
        raise FormatError(f"'{key}' is missing")
    return d[key]


def read_dfg(text: str) -> FollowsGraph:
    d = loaded(text)
    names = need(d, "activities")
    ends = lambda x: {a: fraction(w) for a, w in x.items()} if isinstance(x, dict) else {a: ONE for a in x}
    out = FollowsGraph(list(names), fraction(d.get("empty_traces", 0)), ends(need(d, "start_activities")), ends(need(d, "end_activities")))
    for (a, b), w in need(d, "directly_follows_relations"):
        out.edges[a, b] = fraction(w)
    if not isinstance(d["start_activities"], dict):
        # without weights, what an activity's own count leaves over starts or ends there
        count = {a: fraction(w) for a, w in names.items()}
        out.starts = {a: x for a in out.starts if (x := count[a] - sum((w for (_, b), w in out.edges.items() if b == a), ZERO)) > 0}
        out.ends = {a: x for a in out.ends if (x := count[a] - sum((w for (b, _), w in out.edges.items() if b == a), ZERO)) > 0}
    return out


def write_dfg(g: FollowsGraph) -> str:
    count = {a: g.starts.get(a, ZERO) + sum((w for (_, b), w in g.edges.items() if b == a), ZERO) for a in g.activities}
    say = lambda d: {a: str(w) for a, w in d.items()}
    return json.dumps({"activities": say(count), "directly_follows_relations": [[[a, b], str(w)] for (a, b), w in g.edges.items()], "start_activities": say(g.starts), "end_activities": say(g.ends), "empty_traces": str(g.empty)}, indent=1)


def read_automaton(text: str, stochastic: bool) -> Automaton:
    d = loaded(text)
    edges, n = [], 0
    for t in need(d, "transitions"):
        if stochastic != ("prob" in t):
            raise FormatError("probabilities are missing or out of place")
        edges.append(Edge(int(need(t, "from")), int(need(t, "to")), str(need(t, "label")), fraction(t["prob"]) if stochastic else ONE))
    start = d.get("initialState")
    ends = [] if stochastic else [int(s) for s in need(d, "finalStates")]
    n = 1 + max([-1 if start is None else int(start), *ends, *(x for e in edges for x in (e.source, e.target))])
    seen = set()
    for e in edges:
        if (e.source, e.label) in seen:
            raise FormatError("two edges of a state have the same label")
        seen.add((e.source, e.label))
    if stochastic:
        out = [sum((e.weight for e in edges if e.source == s), ZERO) for s in range(n)]
        if any(p > 1 + Fraction(1, 10**9) for p in out) or any(e.weight < 0 for e in edges):
            raise FormatError("the probabilities of a state add up to more than 1")
        final = {s: ONE - p for s, p in enumerate(out) if p < 1}
    else:
        final = dict.fromkeys(ends, ONE)
    return Automaton(n, None if start is None else int(start), edges, final)


def write_automaton(a: Automaton, stochastic: bool) -> str:
    each = [{"from": e.source, "to": e.target, "label": e.label} | ({"prob": str(e.weight)} if stochastic else {}) for e in a.edges]
    return json.dumps({"initialState": a.start, "transitions": each} | ({} if stochastic else {"finalStates": sorted(a.final)}), indent=1)


def read_powl(text: str) -> Powl:
    d = loaded(text)
    if d.get("format") != "powl-json":
        raise FormatError("expected the format powl-json")
    return _powl(need(d, "model"))


def _powl(d: dict) -> Powl:
    kind, names = need(d, "type"), [x.get("id", str(i)) for i, x in enumerate(d.get("nodes", []))]
    if kind not in ("activity", "partial_order", "choice_graph", "silent"):
        raise FormatError(f"no kind of node: '{kind}'")
    number = {n: i for i, n in enumerate(names)} | {"@start": -1, "@end": -2}
    if len(number) != len(names) + 2:
        raise FormatError("two nodes have the same id")
    edges = [(number[need(e, "source")], number[need(e, "target")]) for e in d.get("edges", [])]
    return Powl("activity" if kind == "silent" else kind, d.get("label"), bool(d.get("skippable")), bool(d.get("repeatable")), [_powl(x) for x in d.get("nodes", [])], edges)


def write_powl(p: Powl) -> str:
    def one(x: Powl, name: str) -> dict:
        d = {"id": name, "type": x.kind, "repeatable": x.repeatable, "skippable": x.skippable}
        say = lambda i: "@start" if i == -1 else "@end" if i == -2 else f"{name}.{i}"
        if x.kind == "activity":
            return d | {"label": x.label}
        return d | {"nodes": [one(c, f"{name}.{i}") for i, c in enumerate(x.children)], "edges": [{"source": say(a), "target": say(b)} for a, b in x.edges]}

    return json.dumps({"format": "powl-json", "format_version": "1.0", "model": one(p, "n")}, indent=1)


def read_tree(text: str, stochastic: bool) -> Tree | None:
    rows = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    title = "stochastic process tree" if stochastic else "process tree"
    if not rows or rows[0] != title:
        raise FormatError(f"expected '{title}'")
    it = iter(rows[1:])

    def one(row: str, depth: int = 0) -> Tree:
        if row == "tau" or row.startswith("activity "):
            leaf = Tree("tau") if row == "tau" else Tree("activity", row[9:])
            leaf.weight = fraction(next(it, "")) if stochastic else ONE
            return leaf
        if row not in OPERATORS:
            raise FormatError(f"no node: '{row}'")
        n = next(it, "")
        if not n.isdigit() or int(n) < 1:
            raise FormatError("the number of children is missing")
        return Tree(row, None, [one(next(it, "")) for _ in range(int(n))])

    first = next(it, None)
    if first is None:
        return None
    tree = one(first)
    if stochastic:
        tree.ending = fraction(next(it, ""))
    if next(it, None) is not None:
        raise FormatError("text after the tree")
    return tree


def write_tree(tree: Tree | None, stochastic: bool) -> str:
    out = ["stochastic process tree" if stochastic else "process tree"]

    def one(t: Tree, indent: str) -> None:
        out.append(indent + (f"activity {t.label}" if t.kind == "activity" else t.kind))
        if t.children:
            out.append(f"{indent}{len(t.children)}")
            for c in t.children:
                one(c, indent + "\t")
        elif stochastic:
            out.append(f"{indent}{t.weight}")

    if tree is not None:
        one(tree, "")
        if stochastic:
            out.append(str(tree.ending))
    return "\n".join(out) + "\n"


def root_of(text: str, name: str) -> ET.Element:
    try:
        root = ET.fromstring(text.encode())
    except ET.ParseError as e:
        raise FormatError(str(e)) from None
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    if root.tag != name:
        raise FormatError(f"expected <{name}>")
    return root


def read_pnml(text: str) -> Net:
    root = root_of(text, "pnml")
    say = lambda e, path, other: (x.text or "").strip() if (x := e.find(path)) is not None else other
    places = {e.get("id"): i for i, e in enumerate(root.iter("place"))}
    net = Net(len(places), tuple(int(say(e, "initialMarking/text", "0") or 0) for e in root.iter("place")), [])
    number = {}
    for e in root.iter("transition"):
        silent = any(x.get("activity") == "$invisible$" for x in e.iter("toolspecific"))
        label = say(e, "name/text", "")
        number[e.get("id")] = len(net.transitions)
        net.transitions.append(Transition(None if silent or not label else label))
    for e in root.iter("arc"):
        a, b, n = e.get("source"), e.get("target"), int(say(e, "inscription/text", "1") or 1)
        if a in places and b in number:
            arcs, p = net.transitions[number[b]].inputs, places[a]
        elif a in number and b in places:
            arcs, p = net.transitions[number[a]].outputs, places[b]
        else:
            raise FormatError("an arc that joins no place with a transition")
        arcs[p] = arcs.get(p, 0) + n
    return net


def write_pnml(net: Net) -> str:
    root = ET.Element("pnml")
    page = ET.SubElement(ET.SubElement(root, "net", id="net", type="http://www.pnml.org/version-2009/grammar/pnmlcoremodel"), "page", id="page")
    text = lambda e, tag, value: setattr(ET.SubElement(ET.SubElement(e, tag), "text"), "text", str(value))
    for p in range(net.places):
        place = ET.SubElement(page, "place", id=f"p{p}")
        if net.marking and net.marking[p]:
            text(place, "initialMarking", net.marking[p])
    for i, t in enumerate(net.transitions):
        e = ET.SubElement(page, "transition", id=f"t{i}")
        text(e, "name", t.label or "")
        if t.label is None:
            ET.SubElement(e, "toolspecific", tool="ProM", version="6.4", activity="$invisible$")
        for arcs, ends in ((t.inputs, lambda p: (f"p{p}", f"t{i}")), (t.outputs, lambda p: (f"t{i}", f"p{p}"))):
            for p, n in arcs.items():
                a, b = ends(p)
                text(ET.SubElement(page, "arc", id=f"{a}-{b}", source=a, target=b), "inscription", n)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


#: Node names of the tree markup and the kinds they stand for.
MARKUP = {"and": "concurrent", "or": "or", "sequence": "sequence", "xor": "xor", "xorLoop": "loop", "interleaved": "interleaved"}
LEAVES = {"manualTask": "activity", "automaticTask": "tau"}


def read_ptml(text: str) -> Tree:
    trees = root_of(text, "ptml").findall("processTree")
    if len(trees) != 1:
        raise FormatError("expected one process tree")
    kinds, children = {}, {}
    for e in trees[0]:
        if e.tag in MARKUP or e.tag in LEAVES:
            if e.get("id") in kinds:
                raise FormatError("two nodes have the same id")
            kinds[e.get("id")] = (MARKUP.get(e.tag) or LEAVES[e.tag], e.get("name"))
            children[e.get("id")] = []
    for e in trees[0].findall("parentsNode"):
        a, b = e.get("sourceId"), e.get("targetId")
        if a not in kinds or b not in kinds:
            raise FormatError("an edge without its nodes")
        children[a].append(b)

    def one(name: str | None, above: tuple = ()) -> Tree:
        if name not in kinds or name in above:
            raise FormatError("the root is missing, or there is a cycle")
        kind, label = kinds[name]
        below = [one(c, (*above, name)) for c in children[name]]
        if kind == "loop" and len(below) == 3:  # body, redo, exit
            return Tree("sequence", None, [Tree("loop", None, below[:2]), below[2]])
        return Tree(kind, label if kind == "activity" else None, below)

    return one(trees[0].get("root"))


def write_ptml(tree: Tree) -> str:
    back = {k: m for m, k in (MARKUP | LEAVES).items()}
    root = ET.Element("ptml")
    top = ET.SubElement(root, "processTree", root="n0")
    edges, count = [], iter(range(1 << 30))

    def one(t: Tree) -> str:
        name = f"n{next(count)}"
        ET.SubElement(top, back[t.kind], id=name, **({"name": t.label} if t.kind == "activity" else {}))
        edges.extend((name, one(c)) for c in t.children)
        return name

    one(tree)
    for a, b in edges:
        ET.SubElement(top, "parentsNode", sourceId=a, targetId=b)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


#: Kinds of diagram nodes that are tasks, events and gateways; pools and messages are not covered.
TASKS = ("task", "userTask", "manualTask", "serviceTask", "scriptTask", "businessRuleTask", "sendTask", "receiveTask")
EVENTS = ("startEvent", "endEvent", "intermediateThrowEvent", "intermediateCatchEvent")
GATEWAYS = ("exclusiveGateway", "parallelGateway", "inclusiveGateway", "eventBasedGateway")
WEIGHTS = "urn:sbpmn"  # readers go by local names, so any name space does


def read_bpmn(text: str, stochastic: bool) -> Diagram:
    root = root_of(text, "definitions")
    if len(root.findall("process")) != 1:
        raise FormatError("expected one process")
    out = Diagram({}, [])
    for e in root.find("process").iter():
        if e.tag in TASKS or e.tag in EVENTS or e.tag in GATEWAYS:
            out.nodes[e.get("id")] = ("task" if e.tag in TASKS else e.tag, e.get("name"))
    if stochastic and not list(root.iter("weight")):
        raise FormatError("no flow has a weight")
    for e in root.iter("sequenceFlow"):
        w = e.find("weight")
        a, b = e.get("sourceRef"), e.get("targetRef")
        if a not in out.nodes or b not in out.nodes:
            raise FormatError("a flow without its nodes")
        out.flows.append((e.get("id"), a, b, fraction(w.get("constant")) if stochastic and w is not None else ONE))
    return out


def write_bpmn(d: Diagram, stochastic: bool) -> str:
    root = ET.Element("definitions", {"id": "definitions", "xmlns": "http://www.omg.org/spec/BPMN/20100524/MODEL"} | ({"xmlns:sbpmn": WEIGHTS} if stochastic else {}))
    process = ET.SubElement(root, "process", id="process", isExecutable="true")
    for name, (kind, label) in d.nodes.items():
        e = ET.SubElement(process, kind, {"id": name} | ({"name": label} if label else {}))
        for side, k in (("incoming", 2), ("outgoing", 1)):
            for f in d.flows:
                if f[k] == name:
                    ET.SubElement(e, side).text = f[0]
    for name, a, b, w in d.flows:
        e = ET.SubElement(process, "sequenceFlow", id=name, sourceRef=a, targetRef=b)
        if stochastic:
            ET.SubElement(e, "sbpmn:weight", constant=str(w))
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def read_lola(text: str) -> Net:
    text = re.sub(r"\{[^}]*\}", " ", text)
    head = re.match(r"\s*PLACE\s+(?:SAFE\s*\d*\s*:)?(.*?);\s*MARKING(.*?);(.*)", text, re.S)
    if not head:
        raise FormatError("expected places and a marking")
    names = [x.strip() for x in re.split("[,;]", re.sub(r"SAFE\s*\d*\s*:", "", head[1])) if x.strip()]
    number = {n: i for i, n in enumerate(names)}

    def arcs(part: str) -> dict[int, int]:
        out: dict[int, int] = {}
        for x in filter(None, map(str.strip, part.split(","))):
            name, _, n = x.partition(":")
            if name.strip() not in number:
                raise FormatError(f"no place {name.strip()}")
            out[number[name.strip()]] = out.get(number[name.strip()], 0) + int(n.strip() or 1)
        return out

    marking = arcs(head[2])
    net = Net(len(names), tuple(marking.get(i, 0) for i in range(len(names))), [])
    body = head[3]
    for m in re.finditer(r"TRANSITION\s+(.+?)\s+(?:(?:STRONG|WEAK)\s+FAIR\s+)?CONSUME(.*?);\s*PRODUCE(.*?);", body, re.S):
        net.transitions.append(Transition(m[1].strip(), arcs(m[2]), arcs(m[3])))
    return net


def write_lola(net: Net) -> str:
    say = lambda d: ", ".join(f"p{p}: {n}" for p, n in d.items())
    rows = [f"PLACE {', '.join(f'p{p}' for p in range(net.places))};", f"MARKING {say({p: m for p, m in enumerate(net.marking or ()) if m})};"]
    rows += [f"TRANSITION {t.label or f'tau{i}'} CONSUME {say(t.inputs)}; PRODUCE {say(t.outputs)};" for i, t in enumerate(net.transitions)]
    return "\n".join(rows) + "\n"


def read_executions(text: str) -> list[dict]:
    rows = need(loaded(text), "executions")
    if not all(isinstance(r, dict) and "fired_transition" in r for r in rows):
        raise FormatError("expected executions")
    return rows


def write_executions(rows: list[dict]) -> str:
    return json.dumps({"executions": rows}, indent=1, default=str)
