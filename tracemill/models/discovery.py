"""Discovery of model objects from (small) variant tables: trees, automata and diagrams.

The variant tables and follows graphs come from DataFrame aggregations; see operators.discovery and formats.from_slang.
"""

from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction
from itertools import pairwise

from .objects import Alignment, Diagram, FollowsGraph, Language, Trace, graph_of_language
from .semantics import ONE, ZERO, Automaton, Edge, Net
from .tree import TAU, Tree, activity, node, reduced, with_weights


def flower_automaton(activities) -> Automaton:
    return Automaton(1, 0, [Edge(0, 0, a) for a in sorted(activities)], {0: ONE})


def flower_tree(activities) -> Tree:
    return node("loop", [TAU, *map(activity, sorted(activities))]) if activities else TAU


def prefix_automaton(traces) -> Automaton:
    states = {(): 0}
    for t in sorted(traces):
        for i in range(len(t)):
            states.setdefault(t[: i + 1], len(states))
    return Automaton(len(states), 0 if traces else None, [Edge(states[t[:-1]], s, t[-1]) for t, s in states.items() if t], {states[t]: ONE for t in traces})


def prefix_tree(traces) -> Tree:
    """Nested choices: after each prefix, stop here if it is a trace, or go on with one of the next activities."""
    ways: dict[str, list[Trace]] = defaultdict(list)
    for t in sorted(traces):
        if t:
            ways[t[0]].append(t[1:])
    branches = [TAU] * (() in traces) + [activity(a) if set(rest) == {()} else node("sequence", [activity(a), prefix_tree(set(rest))]) for a, rest in ways.items()]
    return branches[0] if len(branches) == 1 else node("xor", branches)


def trace_tree(traces) -> Tree:
    one = lambda t: TAU if not t else activity(t[0]) if len(t) == 1 else node("sequence", [activity(a) for a in t])
    branches = [one(t) for t in sorted(traces)]
    return branches[0] if len(branches) == 1 else node("xor", branches)


def weighted_net(net: Net, weight_of) -> Net:
    """``weight_of(transition number, label)``"""
    out = Net(net.places, net.marking, [type(t)(t.label, dict(t.inputs), dict(t.outputs), Fraction(weight_of(i, t.label))) for i, t in enumerate(net.transitions)])
    return out


def weighted_diagram(d: Diagram, weight_of) -> Diagram:
    """``weight_of(label of the flow's target task, or None)``"""
    return Diagram(dict(d.nodes), [(f, a, b, Fraction(weight_of(d.nodes[b][1] if d.nodes[b][0] == "task" else None))) for f, a, b, _ in d.flows])


def occurrence(model, weights: dict[str, Fraction]):
    """Visible steps get the expected occurrences of their label, silent ones 1."""
    of = lambda a: ONE if a is None else weights.get(a, ZERO)
    if isinstance(model, Net):
        return weighted_net(model, lambda _, a: of(a))
    return with_weights(model, of) if isinstance(model, Tree) else weighted_diagram(model, of)


def uniform(model):
    if isinstance(model, Net):
        return weighted_net(model, lambda *_: ONE)
    return with_weights(model, lambda _: ONE) if isinstance(model, Tree) else weighted_diagram(model, lambda _: ONE)


def randomised(model, seed: int | None = None):
    rng = random.Random(seed)
    draw = lambda *_: Fraction(rng.randint(1, 10**10), 10**10)
    if isinstance(model, Net):
        return weighted_net(model, draw)
    return with_weights(model, draw) if isinstance(model, Tree) else weighted_diagram(model, draw)


def by_alignments(net: Net, alignments: list[Alignment]) -> Net:
    fired: dict[int, Fraction] = defaultdict(lambda: ZERO)
    for a in alignments:
        for kind, _, t in a.moves:
            if kind != "log":
                fired[t] += a.weight
    return weighted_net(net, lambda i, _: fired[i])


# --- inductive miner ---


def groups(items, linked) -> list[set]:
    """Connected components of a symmetric relation."""
    left, out = sorted(items), []
    while left:
        group, todo = set(), [left[0]]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in left if y not in group and linked(x, y)]
        left = [x for x in left if x not in group]
        out.append(group)
    return out


def reach(g: FollowsGraph) -> dict[str, set[str]]:
    after: dict[str, set[str]] = {a: set() for a in g.activities}
    for a, b in g.edges:
        after[a].add(b)
    out = {}
    for a in g.activities:
        seen, todo = set(), list(after[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        out[a] = seen
    return out


def xor_cut(g: FollowsGraph, _log: Language) -> list[set] | None:
    parts = groups(g.activities, lambda a, b: (a, b) in g.edges or (b, a) in g.edges)
    return parts if len(parts) > 1 else None


def sequence_cut(g: FollowsGraph, _log: Language) -> list[set] | None:
    r = reach(g)
    parts = groups(g.activities, lambda a, b: (b in r[a]) == (a in r[b]))
    if len(parts) < 2:
        return None
    first = lambda p: next(iter(p))
    return sorted(parts, key=lambda p: sum(first(p) in r[first(q)] for q in parts if q is not p))


def concurrent_cut(g: FollowsGraph, log: Language) -> list[set] | None:
    if not g.starts or not g.ends:
        return None
    apart = minimum_self_distance(log)
    parts = groups(g.activities, lambda a, b: (a, b) not in g.edges or (b, a) not in g.edges or b in apart.get(a, ()) or a in apart.get(b, ()))
    whole = [p for p in parts if p & g.starts.keys() and p & g.ends.keys()]
    rest = [p for p in parts if p not in whole]
    if len(whole) < 2:
        return None
    for p in rest:
        whole[0] |= p
    return whole


def minimum_self_distance(log: Language) -> dict[str, set[str]]:
    """What lies between two occurrences of an activity where these are nearest to each other."""
    least, between = {}, defaultdict(set)
    for t in log:
        last: dict[str, int] = {}
        for i, a in enumerate(t):
            if a in last:
                d, inner = i - last[a], set(t[last[a] + 1 : i])
                if d < least.get(a, 1 << 60):
                    least[a], between[a] = d, inner
                elif d == least[a]:
                    between[a] |= inner
            last[a] = i
    return between


def loop_cut(g: FollowsGraph, _log: Language) -> list[set] | None:
    if not g.starts or not g.ends:
        return None
    body = g.starts.keys() | g.ends.keys()
    parts = groups([a for a in g.activities if a not in body], lambda a, b: (a, b) in g.edges or (b, a) in g.edges)
    good = []
    for p in parts:
        into, out = {(a, b) for a, b in g.edges if b in p and a not in p}, {(a, b) for a, b in g.edges if a in p and b not in p}
        entered, left = {b for _, b in into}, {a for a, _ in out}
        redo = all(a in g.ends for a, _ in into) and all(b in g.starts for _, b in out) and into and out
        if redo and all((e, b) in g.edges for e in g.ends for b in entered) and all((a, s) in g.edges for s in g.starts for a in left):
            good.append(p)
        else:
            body = body | p
    return [set(body), *good] if good else None


def split_xor(log: Language, parts: list[set]) -> list[Language]:
    out: list[Language] = [defaultdict(lambda: ZERO) for _ in parts]
    for t, p in log.items():
        fit = max(range(len(parts)), key=lambda i: (sum(a in parts[i] for a in t), -i))
        out[fit][tuple(a for a in t if a in parts[fit])] += p
    return out


def split_sequence(log: Language, parts: list[set]) -> list[Language]:
    """Each trace is cut where the fewest events are on the wrong side."""
    out: list[Language] = [defaultdict(lambda: ZERO) for _ in parts]
    for t, p in log.items():
        at = 0
        for i, part in enumerate(parts):
            if i == len(parts) - 1:
                end = len(t)
            else:
                later, best, end, wrong = set().union(*parts[i + 1 :]), 0, at, 0
                for k in range(at, len(t)):
                    wrong += -1 if t[k] in part else t[k] in later
                    if wrong < best:
                        best, end = wrong, k + 1
            out[i][tuple(a for a in t[at:end] if a in part)] += p
            at = end
    return out


def split_concurrent(log: Language, parts: list[set]) -> list[Language]:
    out: list[Language] = [defaultdict(lambda: ZERO) for _ in parts]
    for t, p in log.items():
        for o, part in zip(out, parts, strict=True):
            o[tuple(a for a in t if a in part)] += p
    return out


def split_loop(log: Language, parts: list[set]) -> list[Language]:
    out: list[Language] = [defaultdict(lambda: ZERO) for _ in parts]
    of = {a: i for i, part in enumerate(parts) for a in part}
    for t, p in log.items():
        pieces: list[tuple[int, list[str]]] = [(0, [])]
        for a in t:
            if of[a] != pieces[-1][0]:
                if of[a] and pieces[-1][0]:
                    pieces.append((0, []))
                pieces.append((of[a], []))
            pieces[-1][1].append(a)
        if pieces[-1][0]:
            pieces.append((0, []))
        for i, piece in pieces:
            out[i][tuple(piece)] += p
    return out


CUTS = (("xor", xor_cut, split_xor), ("sequence", sequence_cut, split_sequence), ("concurrent", concurrent_cut, split_concurrent), ("loop", loop_cut, split_loop))


def filtered(g: FollowsGraph, noise: Fraction) -> FollowsGraph:
    """Without starts below a share of all starts and edges and ends below a share of what leaves their source."""
    out: dict[str, Fraction] = defaultdict(lambda: ZERO)
    for (a, _), w in g.edges.items():
        out[a] += w
    for a, w in g.ends.items():
        out[a] += w
    starts = sum(g.starts.values(), ZERO)
    return FollowsGraph(g.activities, g.empty, {a: w for a, w in g.starts.items() if w >= noise * starts}, {a: w for a, w in g.ends.items() if w >= noise * out[a]}, {e: w for e, w in g.edges.items() if w >= noise * out[e[0]]})


def inductive(log: Language, noise: Fraction | None = None) -> Tree:
    """The inductive miner; with ``noise`` its variant for infrequent behaviour. The tree is reduced."""
    return reduced(_mine({t: p for t, p in log.items() if p > 0}, noise))


def _mine(log: Language, noise: Fraction | None) -> Tree:
    total, empty = sum(log.values(), ZERO), log.get((), ZERO)
    names = sorted({a for t in log for a in t})
    if not names:
        return TAU
    if len(names) == 1 and base_case(log, total, noise):
        return activity(names[0])
    if empty:
        rest = {t: p for t, p in log.items() if t}
        if noise is not None and empty < noise * total:
            return _mine(rest, noise)
        return node("xor", [TAU, _mine(rest, noise)])
    g = graph_of_language(log)
    for graph in [g] if noise is None else [g, filtered(g, noise)]:
        for kind, cut, split in CUTS:
            if parts := cut(graph, log):
                return node(kind, [_mine(dict(s), noise) for s in split(log, parts)])
    return fall_through(log, g, names, noise)


def base_case(log: Language, total: Fraction, noise: Fraction | None) -> bool:
    if noise is None:
        return all(len(t) == 1 for t in log)
    events = sum((len(t) * p for t, p in log.items()), ZERO)
    return log.get((), ZERO) < noise * total and abs(total / (total + events) - Fraction(1, 2)) < noise


def fall_through(log: Language, g: FollowsGraph, names: list[str], noise: Fraction | None) -> Tree:
    if len(names) > 1:
        for a in names:  # once in every trace
            if all(t.count(a) == 1 for t in log):
                return node("concurrent", [activity(a), _mine(dict(split_concurrent(log, [set(names) - {a}])[0]), noise)])
        for a in names:  # an activity that hides a cut of the others
            rest = dict(split_concurrent(log, [set(names) - {a}])[0])
            own = {t: p for t, p in rest.items() if t}
            h = graph_of_language(own)
            if len(h.activities) > 1 and any(cut(h, own) for _, cut, _ in CUTS):
                return node("concurrent", [_mine(dict(split_concurrent(log, [{a}])[0]), noise), _mine(rest, noise)])
    strict = lambda a, b: a in g.ends and b in g.starts
    loose = lambda a, b: b in g.starts
    for again in (strict, loose):
        parts: Language = defaultdict(lambda: ZERO)
        for t, p in log.items():
            at = 0
            for i, (a, b) in enumerate(pairwise(t), 1):
                if again(a, b):
                    parts[t[at:i]] += p
                    at = i
            parts[t[at:]] += p
        if set(parts) != set(log):
            return node("loop", [_mine(dict(parts), noise), TAU])
    return flower_tree(names)


# --- split miner ---


def split_miner(log: Language, epsilon: Fraction = Fraction(1, 10), eta: Fraction = Fraction(2, 5)) -> Diagram:
    """Follows graph without self-loops, concurrency by balanced pairs of activities that don't follow themselves, filtering by the best ways in and out, splits from
    the follows relation, joins where flows meet; joins of what was split in parallel are inclusive. Self-loops come back
    as tasks that may repeat."""
    g = graph_of_language(log)
    loops = {a for a, b in g.edges if a == b}
    short = {(t[i], t[i + 1]) for t in log for i in range(len(t) - 2) if t[i] == t[i + 2] != t[i + 1]}
    w = {(a, b): x for (a, b), x in g.edges.items() if a != b}
    even = {(a, b) for (a, b) in w if (b, a) in w and not {a, b} & loops and (a, b) not in short and (b, a) not in short and abs(w[a, b] - w[b, a]) <= epsilon * (w[a, b] + w[b, a])}
    kept = {e: x for e, x in w.items() if e not in even and not (e[::-1] in w and e[::-1] not in even and w[e[::-1]] > x and e not in short)}
    for a, x in g.starts.items():
        kept["start", a] = x
    for a, x in g.ends.items():
        kept[a, "end"] = x
    nodes = [*g.activities]
    best = {max((e for e in kept if e[i] == a), key=lambda e: (kept[e], e), default=None) for a in nodes for i in (0, 1)} - {None}
    ranked = sorted(kept[e] for e in best)
    least = ranked[min(len(ranked) - 1, int(eta * len(ranked)))] if ranked else ZERO
    chosen = {e for e in kept if e in best or kept[e] >= least}
    chosen |= connecting(nodes, kept, chosen)
    return diagram(nodes, chosen, even, loops)


def connecting(nodes: list[str], kept: dict, chosen: set) -> set:
    """The heaviest further edges that put every activity on a way from the start to the end."""
    extra: set = set()

    def reached(first: str, i: int) -> set:
        seen, todo = {first}, [first]
        while todo:
            x = todo.pop()
            for e in chosen | extra:
                if e[i] == x and e[1 - i] not in seen:
                    seen.add(e[1 - i])
                    todo.append(e[1 - i])
        return seen

    for first, i in (("start", 0), ("end", 1)):
        while missing := set(nodes) - (seen := reached(first, i)):
            options = [e for e in kept if e[i] in seen and e[1 - i] in missing]
            if not options:
                break
            extra.add(max(options, key=lambda e: (kept[e], e)))
    return extra


def gateways(options: list[str], even: set, nodes: list[str]) -> tuple:
    """A tree (kind, part, part) over the activities after (or before) another: alike ones, with the same activities at the
    same time, are a choice; ones that may run at the same time and complement each other are parallel; what is neither is
    inclusive."""
    front = [(frozenset({b}), frozenset(c for c in nodes if (b, c) in even), b) for b in sorted(options)]
    while len(front) > 1:
        pairs = [(x, y) for i, x in enumerate(front) for y in front[i + 1 :]]
        alike = next((p for p in pairs if p[0][1] == p[1][1]), None)
        whole = next((p for p in pairs if p[0][0] | p[0][1] == p[1][0] | p[1][1]), None)
        x, y = alike or whole or pairs[0]
        kind = "exclusiveGateway" if alike else "parallelGateway" if whole else "inclusiveGateway"
        front = [f for f in front if f is not x and f is not y] + [(x[0] | y[0], x[1] & y[1], (kind, x[2], y[2]))]
    return front[0][2]


def diagram(nodes: list[str], edges: set, even: set, loops: set) -> Diagram:
    """Each follows edge runs from a leaf of its source's split to a leaf of its target's join."""
    d, count = Diagram({"start": ("startEvent", None), "end": ("endEvent", None)} | {f"task {a}": ("task", a) for a in nodes}, []), iter(range(1 << 30))
    enter, leave = ({x: x if x in ("start", "end") else f"task {x}" for x in ("start", "end", *nodes)} for _ in range(2))

    def flow(a: str, b: str) -> None:
        d.flows.append((f"f{len(d.flows)}", a, b, ONE))

    def gateway(kind: str) -> str:
        d.nodes[k := f"g{next(count)}"] = (kind, None)
        return k

    for a in sorted(loops):
        enter[a], leave[a] = gateway("exclusiveGateway"), gateway("exclusiveGateway")
        flow(enter[a], f"task {a}")
        flow(f"task {a}", leave[a])
        flow(leave[a], enter[a])
    ports: list[dict[tuple[str, str], str]] = [{}, {}]
    for side, at in ((0, leave), (1, enter)):
        for x in at:
            options = [e[1 - side] for e in edges if e[side] == x]

            def attach(tree, here: str, x=x, side=side) -> None:
                if isinstance(tree, str):
                    ports[side][(x, tree) if side == 0 else (tree, x)] = here
                    return
                k = here if d.nodes[here][0] == tree[0] and here not in (enter.get(x), leave.get(x)) else gateway(tree[0])
                if k != here:
                    flow(*((here, k) if side == 0 else (k, here)))
                for part in tree[1:]:
                    attach(part, k)

            if options:
                attach(gateways(options, even, nodes), at[x])
    for e in sorted(edges):
        flow(ports[0][e], ports[1][e])
    return d
