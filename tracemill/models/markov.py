"""Probabilities on stochastic models: exact linear systems, determinisation, best-first enumeration, abstractions."""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

from .semantics import ONE, ZERO, Automaton, Edge, Graph, Semantics, explored

Rows = list[dict[int, Fraction]]


def solved(rows: Rows, right: list[dict[int, Fraction]]) -> list[dict[int, Fraction]]:
    """X with X = rows · X + right, for sparse rows with a convergent sum; right and X have sparse columns.

    Eliminates one unknown after the other, the one with the fewest entries first. Raises ZeroDivisionError if singular.
    """
    rows, right = [dict(r) for r in rows], [dict(r) for r in right]
    users: list[set[int]] = [set() for _ in rows]
    for i, r in enumerate(rows):
        for j in r:
            users[j].add(i)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]) * len(users[i]))
    for k in order:
        if k in rows[k]:
            scale = ONE / (ONE - rows[k].pop(k))
            users[k].discard(k)
            rows[k] = {j: v * scale for j, v in rows[k].items()}
            right[k] = {j: v * scale for j, v in right[k].items()}
        for i in list(users[k]):
            factor = rows[i].pop(k)
            for j, v in rows[k].items():
                rows[i][j] = rows[i].get(j, ZERO) + factor * v
                users[j].add(i)
            for j, v in right[k].items():
                right[i][j] = right[i].get(j, ZERO) + factor * v
        users[k] = set()
    # rows may still refer to unknowns that were eliminated later: put these in, last first
    for k in reversed(order):
        for j, v in list(rows[k].items()):
            for c, x in right[j].items():
                right[k][c] = right[k].get(c, ZERO) + v * x
        rows[k] = {}
    return right


def split(model: Semantics, graph: Graph) -> tuple[Rows, list[dict[str, dict[int, Fraction]]], set[int]]:
    """Silent steps between live states, visible steps by label, and the live states: those that can reach a final one."""
    live = graph.reaching(graph.finals())
    silent: Rows = [{} for _ in graph.states]
    visible: list[dict[str, dict[int, Fraction]]] = [defaultdict(dict) for _ in graph.states]
    for s, es in enumerate(graph.edges):
        if s in live:
            for i, p, t in es:
                if t in live:
                    label = model.label(i)
                    to = silent[s] if label is None else visible[s][label]
                    to[t] = to.get(t, ZERO) + p
    return silent, visible, live


class Determinised:
    """States are distributions over model states; successors follow from the closure of the silent steps."""

    def __init__(self, model: Semantics, limit: int = 100_000):
        self.graph = explored(model, limit)
        silent, self.visible, live = split(model, self.graph)
        self.ends = set(self.graph.finals())
        n = len(self.graph.states)
        self.visits = solved(silent, [{s: ONE} for s in range(n)]) if n else []
        self.empty = not n or 0 not in live

    def start(self) -> dict[int, Fraction]:
        return {} if self.empty else {0: ONE}

    def steps(self, mass: dict[int, Fraction]) -> tuple[Fraction, dict[str, dict[int, Fraction]]]:
        """Probability of ending here, and the mass after each label; the mass of what never ends is left out."""
        here: dict[int, Fraction] = defaultdict(lambda: ZERO)
        for s, p in mass.items():
            for t, v in self.visits[s].items():
                here[t] += p * v
        after: dict[str, dict[int, Fraction]] = defaultdict(lambda: defaultdict(lambda: ZERO))
        for s, p in here.items():
            for label, to in self.visible[s].items():
                for t, q in to.items():
                    after[label][t] += p * q
        return sum((p for s, p in here.items() if s in self.ends), ZERO), after


def determinised(model: Semantics) -> Determinised:
    """Built once per model object and kept with it."""
    found = model.__dict__.get("_determinised")
    if found is None:
        found = model.__dict__["_determinised"] = Determinised(model)
    return found


def trace_probability(model: Semantics, trace: list[str] | tuple[str, ...]) -> Fraction:
    """Forwards over the trace: the mass in each state before each event, silent steps closed by one linear system."""
    det = determinised(model)
    mass = det.start()
    for a in trace:
        mass = det.steps(mass)[1].get(a, {}) if mass else {}
    return det.steps(mass)[0] if mass else ZERO


def enumerated(model: Semantics, prune: Fraction = ZERO, limit: int = 200_000) -> Iterator[tuple[Fraction, tuple[str, ...]]]:
    """Traces in falling order of probability: a queue of prefixes, each with the mass that can still end, and of whole
    traces. Prefixes with less mass than ``prune`` are dropped; more than ``limit`` steps raise RuntimeError."""
    det, count = determinised(model), itertools.count()
    start = det.start()
    queue = [(-ONE, next(count), (), start)] if start else []
    for _ in range(limit):
        if not queue:
            return
        p, _, trace, mass = heapq.heappop(queue)
        if mass is None:
            yield -p, trace
            continue
        end, after = det.steps(mass)
        if end > 0 and end >= prune:
            heapq.heappush(queue, (-end, next(count), trace, None))
        for label in sorted(after):
            total = sum(after[label].values(), ZERO)
            if total > 0 and total >= prune:
                heapq.heappush(queue, (-total, next(count), (*trace, label), dict(after[label])))
    raise RuntimeError(f"more than {limit} steps; the language may be infinite")


def minimum_probability(model: Semantics, q: Fraction) -> list[tuple[Fraction, tuple[str, ...]]]:
    return [(p, t) for p, t in enumerated(model, q) if p >= q]


def most_likely(model: Semantics, k: int) -> list[tuple[Fraction, tuple[str, ...]]]:
    return list(itertools.islice(enumerated(model), k))


def coverage(model: Semantics, q: Fraction) -> list[tuple[Fraction, tuple[str, ...]]]:
    out, total = [], ZERO
    if q == 0:
        return out
    for p, t in enumerated(model):
        out.append((p, t))
        total += p
        if total >= q:
            return out
    raise ValueError(f"the traces cover only {total}")


def expected_visits(model: Semantics) -> tuple[Graph, list[Fraction]]:
    """Expected visits of each live state, of those runs that stay among live states."""
    graph = explored(model)
    live = graph.reaching(graph.finals())
    inwards: Rows = [{} for _ in graph.states]
    for s, es in enumerate(graph.edges):
        if s in live:
            for _, p, t in es:
                if t in live:
                    inwards[t][s] = inwards[t].get(s, ZERO) + p
    x = solved(inwards, [{0: ONE} if s == 0 and 0 in live else {} for s in range(len(graph.states))])
    return graph, [v.get(0, ZERO) for v in x]


def entropy(model: Semantics, share: float = 0.0) -> float:
    """Entropy of a deterministic model's language: expected visits times the entropy of each state's choice, its ending
    included; livelocks count with the choices that lead to them. ``share`` splits each probability, as the gain does."""
    graph, visits = expected_visits(model)
    h = lambda p: -p * math.log2(p) if p > 0 else 0.0
    part = lambda p: h(p * (1 - share)) + h(p * share) if share else h(p)
    return sum(float(v) * sum(part(float(p)) for _, p, _ in graph.edges[s]) for s, v in enumerate(visits) if v)


def without_silent(model: Semantics) -> Automaton:
    """The stochastic automaton of visible steps only; unreachable states go."""
    graph = explored(model)
    if not graph.states:
        return Automaton(0, None, [], {})
    silent, visible, live = split(model, graph)
    closure = solved(silent, [{s: ONE} for s in range(len(graph.states))])
    ends, index, order, edges, final = set(graph.finals()), {0: 0}, [0], [], {}
    for s in order:
        for t, p in closure[s].items():
            if t in ends and p:
                final[index[s]] = final.get(index[s], ZERO) + p
            for label, to in visible[t].items():
                for u, q in to.items():
                    if u not in index:
                        index[u] = len(order)
                        order.append(u)
                    edges.append((index[s], index[u], label, p * q))
    merged: dict[tuple, Fraction] = defaultdict(lambda: ZERO)
    for a, b, label, p in edges:
        merged[a, b, label] += p
    return Automaton(len(order), 0, [Edge(a, b, label, p) for (a, b, label), p in merged.items()], final)


def abstraction(model: Semantics, k: int, start: str = "+", end: str = "-") -> dict[tuple[str, ...], Fraction]:
    """The stochastic language of k-grams of the model's traces with start and end marks; shorter traces count as a whole."""
    auto = without_silent(model)
    if auto.start is None:
        return {}
    n = auto.states
    first, last = n, n + 1
    steps: list[list[tuple[str, Fraction, int]]] = [[] for _ in range(n + 2)]
    for e in auto.edges:
        steps[e.source].append((e.label, e.weight, e.target))
    for s, p in auto.final.items():
        steps[s].append((end, p, last))
    steps[first].append((start, ONE, auto.start))
    inwards: Rows = [{} for _ in range(n + 2)]
    for s, out in enumerate(steps):
        for _, p, t in out:
            inwards[t][s] = inwards[t].get(s, ZERO) + p
    visits = [v.get(0, ZERO) for v in solved(inwards, [{0: ONE} if s == first else {} for s in range(n + 2)])]
    grams: dict[tuple[str, ...], Fraction] = defaultdict(lambda: ZERO)
    for s, v in enumerate(visits):
        if not v:
            continue
        layer = {((), s): v}
        for _ in range(k):
            after: dict[tuple, Fraction] = defaultdict(lambda: ZERO)
            for (g, q), p in layer.items():
                if q == last and g and g[0] == start:
                    grams[g] += p  # a whole trace, shorter than k
                for label, w, t in steps[q]:
                    after[(*g, label), t] += p * w
            layer = after
        for (g, _), p in layer.items():
            grams[g] += p
    total = sum(grams.values(), ZERO)
    return {g: p / total for g, p in grams.items()} if total else {}
