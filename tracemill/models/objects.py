"""Small objects that files hold and models come from, and the conversions between them."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from fractions import Fraction

from .semantics import ONE, ZERO, Automaton, Edge, Net, Semantics, explored
from .tree import Tree, activity, net_of, node

Trace = tuple[str, ...]
Language = dict[Trace, Fraction]


@dataclass
class FollowsGraph:
    """A directly-follows graph or model; weights are None where the format has none."""

    activities: list[str]
    empty: Fraction = ZERO
    starts: dict[str, Fraction] = field(default_factory=dict)
    ends: dict[str, Fraction] = field(default_factory=dict)
    edges: dict[tuple[str, str], Fraction] = field(default_factory=dict)


@dataclass
class Order:
    """A partially ordered trace: events with the numbers of their predecessors, and its probability."""

    events: list[tuple[str, tuple[int, ...]]]
    probability: Fraction


@dataclass
class Alignment:
    moves: list[tuple[str, str | None, int | None]]
    weight: Fraction = ONE


@dataclass
class Powl:
    """A node: ``activity``, ``partial_order`` or ``choice_graph``; edges name the numbers of children, -1 start, -2 end."""

    kind: str
    label: str | None = None
    skippable: bool = False
    repeatable: bool = False
    children: list[Powl] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Diagram:
    """A process diagram: nodes by id with kind and name, flows (id, source, target, weight)."""

    nodes: dict[str, tuple[str, str | None]]
    flows: list[tuple[str, str, str, Fraction]]


def automaton_of_graph(graph: FollowsGraph) -> Automaton:
    """A start state, then one state per activity; probabilities are shares of what leaves a state."""
    number = {a: i + 1 for i, a in enumerate(graph.activities)}
    out: dict[int, list] = defaultdict(list)
    for a, w in graph.starts.items():
        out[0].append((number[a], a, w))
    for (a, b), w in graph.edges.items():
        out[number[a]].append((number[b], b, w))
    end = {0: graph.empty} | {number[a]: w for a, w in graph.ends.items()}
    edges, final = [], {}
    for s in range(len(number) + 1):
        total = sum((w for *_, w in out[s]), ZERO) + end.get(s, ZERO)
        if total > 0:
            edges += [Edge(s, t, a, w / total) for t, a, w in out[s] if w > 0]
            if end.get(s, ZERO) > 0:
                final[s] = end[s] / total
    return Automaton(len(number) + 1, 0 if edges or final else None, edges, final)


def automaton_of_language(language: Language) -> Automaton:
    """The prefix automaton. Mass that the language lacks stays in the start as a loop that never ends."""
    states, cnt = {(): 0}, defaultdict(lambda: ZERO)
    ends: dict[Trace, Fraction] = defaultdict(lambda: ZERO)
    for trace, p in language.items():
        for i in range(len(trace)):
            states.setdefault(trace[: i + 1], len(states))
            cnt[trace[: i + 1]] += p
        ends[trace] += p
    mass = {(): ONE} | dict(cnt)
    edges = [Edge(states[t[:-1]], s, t[-1], cnt[t] / mass[t[:-1]]) for t, s in states.items() if t]
    missing = ONE - sum(language.values(), ZERO)
    if missing > 0 and language:
        dead = len(states)
        return Automaton(dead + 1, 0, [*edges, Edge(0, dead, None, missing), Edge(dead, dead, None, ONE)], {states[t]: p / mass[t] for t, p in ends.items()})
    return Automaton(len(states), 0 if language else None, edges, {states[t]: p / mass[t] for t, p in ends.items()})


def graph_of_language(language: Language) -> FollowsGraph:
    g = FollowsGraph(sorted({a for t in language for a in t}))
    add = lambda d, k, p: d.__setitem__(k, d.get(k, ZERO) + p)
    for t, p in language.items():
        if not t:
            g.empty += p
            continue
        add(g.starts, t[0], p)
        add(g.ends, t[-1], p)
        for pair in zip(t, t[1:], strict=False):
            add(g.edges, pair, p)
    return g


def net_of_automaton(auto: Automaton) -> Net:
    """A place per state."""
    if auto.start is None:
        return Net(0, None, [])
    net = Net(auto.states, tuple(int(s == auto.start) for s in range(auto.states)), [])
    for e in auto.edges:
        net.add(e.label, [e.source], [e.target], e.weight)
    for s, p in auto.final.items():
        net.add(None, [s], [], p)
    left = {e.source for e in auto.edges}
    for s in range(auto.states):  # a state without a way on never ends
        if s not in left and s not in auto.final:
            net.add(None, [s], [s])
    return net


def automaton_of(model: Semantics, limit: int = 100_000) -> Automaton:
    """The reachability graph as an automaton; final markings end with certainty."""
    graph = explored(model, limit)
    edges = [Edge(s, t, model.label(i), p) for s, es in enumerate(graph.edges) for i, p, t in es]
    return Automaton(len(graph.states), 0 if graph.states else None, edges, {s: ONE for s in graph.finals()})


def net_of_powl(powl: Powl) -> Net:
    net = Net(0, (), [])
    a, b = net.add_place(1), net.add_place()
    _powl(net, powl, a, b)
    net.add(None, [b], [])
    return net


def _powl(net: Net, powl: Powl, a: int, b: int) -> None:
    if powl.skippable:
        net.add(None, [a], [b])
    if powl.repeatable:
        inner, done = net.add_place(), net.add_place()
        net.add(None, [a], [inner])
        net.add(None, [done], [inner])
        net.add(None, [done], [b])
        a, b = inner, done
    if powl.kind == "activity":
        net.add(powl.label, [a], [b])
        return
    ins, outs = [net.add_place() for _ in powl.children], [net.add_place() for _ in powl.children]
    if powl.kind == "choice_graph":
        for x, y in powl.edges:
            net.add(None, [a if x == -1 else outs[x]], [b if y == -2 else ins[y]])
        for c, x, y in zip(powl.children, ins, outs, strict=True):
            _powl(net, c, x, y)
        return
    between = {e: net.add_place() for e in powl.edges}
    ready = [net.add_place() for _ in powl.children]
    net.add(None, [a], ready)
    done = [net.add_place() for _ in powl.children]
    for i, c in enumerate(powl.children):
        net.add(None, [ready[i], *(p for (_, y), p in between.items() if y == i)], [ins[i]])
        net.add(None, [outs[i]], [done[i], *(p for (x, _), p in between.items() if x == i)])
        _powl(net, c, ins[i], outs[i])
    net.add(None, done, [b])


def tree_of_powl(powl: Powl) -> Tree:
    """Only partial orders without edges and choices without cycles between children are trees; else ValueError."""
    if powl.kind == "activity":
        out = activity(powl.label)
    elif powl.kind == "partial_order" and not powl.edges:
        out = node("concurrent", [tree_of_powl(c) for c in powl.children])
    elif powl.kind == "partial_order" and len(powl.edges) >= len(powl.children) - 1 and _chain(powl):
        out = node("sequence", [tree_of_powl(powl.children[i]) for i in _chain(powl)])
    elif powl.kind == "choice_graph" and all(x == -1 or y == -2 for x, y in powl.edges):
        out = node("xor", [tree_of_powl(c) for c in powl.children])
    else:
        raise ValueError("this model is no process tree")
    out = node("loop", [out, Tree("tau")]) if powl.repeatable else out
    return node("xor", [out, Tree("tau")]) if powl.skippable else out


def _chain(powl: Powl) -> list[int] | None:
    before = {i: {x for x, y in powl.edges if y == i} for i in range(len(powl.children))}
    order = sorted(before, key=lambda i: len(before[i]))
    return order if all(before[i] >= {order[k - 1]} for k, i in enumerate(order) if k) else None


def net_of_diagram(diagram: Diagram, inclusive_limit: int = 6) -> Net:
    """Flows are places. Tasks pass one token, exclusive gateways one of many, parallel ones all; an inclusive split takes
    any non-empty set, and an inclusive join waits for the same set as its split where one split has that many branches,
    otherwise any of its flows passes on."""
    place = {f[0]: i for i, f in enumerate(diagram.flows)}
    net = Net(len(place), (0,) * len(place), [])
    weight = {f[0]: f[3] for f in diagram.flows}
    for name, (kind, label) in diagram.nodes.items():
        ins = [place[f[0]] for f in diagram.flows if f[2] == name]
        outs = [f[0] for f in diagram.flows if f[1] == name]
        if kind == "startEvent" or (not ins and kind != "endEvent"):
            source = net.add_place(1)
            ins = [source]
        text = label if kind == "task" else None
        to = [place[o] for o in outs]
        if kind == "parallelGateway":
            net.add(None, ins, to)
        elif kind == "inclusiveGateway" and len(to) > 1:
            if len(to) > inclusive_limit:
                raise ValueError("too many branches of an inclusive gateway")
            for i in ins:
                for bits in range(1, 1 << len(to)):
                    net.add(None, [i], [t for k, t in enumerate(to) if bits >> k & 1])
        elif kind in ("exclusiveGateway", "inclusiveGateway", "eventBasedGateway"):
            for i in ins:
                for o in outs:
                    net.add(None, [i], [place[o]], weight[o])
                if not outs:
                    net.add(None, [i], [])
        else:  # several flows into a task or event pass singly, several out of it all
            for i in ins:
                net.add(text, [i], to)
    return net


def diagram_of_tree(tree: Tree) -> Diagram:
    """Blocks of gateways; inclusive and interleaved blocks become inclusive and parallel gateways."""
    d, count = Diagram({}, []), iter(range(1 << 30))

    def new(kind: str, name: str | None = None) -> str:
        d.nodes[k := f"n{next(count)}"] = (kind, name)
        return k

    def flow(a: str, b: str) -> None:
        d.flows.append((f"f{len(d.flows)}", a, b, ONE))

    def block(t: Tree) -> tuple[str, str]:
        if t.kind == "activity":
            return (x := new("task", t.label)), x
        if t.kind == "tau":
            return (x := new("intermediateThrowEvent")), x
        parts = [block(c) for c in t.children]
        if t.kind == "sequence":
            for (_, x), (y, _) in zip(parts, parts[1:], strict=False):
                flow(x, y)
            return parts[0][0], parts[-1][1]
        kind = {"xor": "exclusiveGateway", "loop": "exclusiveGateway", "or": "inclusiveGateway"}.get(t.kind, "parallelGateway")
        a, b = new(kind), new(kind)
        for i, (x, y) in enumerate(parts):
            back = t.kind == "loop" and i > 0
            flow(b if back else a, x)
            flow(y, a if back else b)
        return a, b

    start, end = new("startEvent"), new("endEvent")
    a, b = block(tree)
    flow(start, a)
    flow(b, end)
    return d


def diagram_of_net(net: Net) -> Diagram:
    """Places become exclusive gateways, transitions tasks between parallel gateways; only for nets whose marking is one
    token and in which every place has a way in."""
    if net.marking is None or sum(net.marking) != 1:
        raise ValueError("only nets with one token become diagrams")
    d = Diagram({"start": ("startEvent", None), "end": ("endEvent", None)}, [])

    def flow(a: str, b: str, w: Fraction = ONE) -> None:
        d.flows.append((f"f{len(d.flows)}", a, b, w))

    for p in range(net.places):
        d.nodes[f"p{p}"] = ("exclusiveGateway", None)
        if net.marking[p]:
            flow("start", f"p{p}")
    for i, t in enumerate(net.transitions):
        d.nodes[f"t{i}"] = ("task", t.label) if t.label is not None else ("intermediateThrowEvent", None)
        first = last = f"t{i}"
        if len(t.inputs) > 1:
            d.nodes[first := f"j{i}"] = ("parallelGateway", None)
            flow(first, f"t{i}")
        if len(t.outputs) > 1:
            d.nodes[last := f"s{i}"] = ("parallelGateway", None)
            flow(f"t{i}", last)
        for p in t.inputs:
            flow(f"p{p}", first, t.weight)
        for p in t.outputs:
            flow(last, f"p{p}")
        if not t.outputs:
            flow(last, "end")
    return d


def as_model(thing) -> Semantics:
    """The transition system of any object."""
    if isinstance(thing, (Net, Automaton)):
        return thing
    if isinstance(thing, Tree):
        return net_of(thing)
    if isinstance(thing, FollowsGraph):
        return automaton_of_graph(thing)
    if isinstance(thing, Powl):
        return net_of_powl(thing)
    if isinstance(thing, Diagram):
        return net_of_diagram(thing)
    if isinstance(thing, dict):
        return automaton_of_language(thing)
    if isinstance(thing, (set, frozenset)):
        return automaton_of_language({t: Fraction(1, len(thing)) for t in thing})
    raise TypeError(f"{type(thing).__name__} has no traces")


def as_net(thing) -> Net:
    model = as_model(thing)
    return model if isinstance(model, Net) else net_of_automaton(model)


