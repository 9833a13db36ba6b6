"""Searches per trace: alignments, explanations, random walks, partial orders; and the distance of two languages."""

from __future__ import annotations

import heapq
import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np

from .edits import Normalised
from .semantics import Semantics, any_traces, non_decreasing_livelock
from .transport import transport

#: Costs of the moves of an alignment.
LOG_MOVE, MODEL_MOVE, SILENT_MOVE, SYNCHRONOUS_MOVE = 10_000, 10_000, 1, 0
#: States whose steps are kept for further walks.
MOST_KNOWN = 200_000
Move = tuple[str, str | None, int | None]


class NoAlignment(ValueError):
    """The model has no trace."""


def align(model: Semantics, trace: list[str] | tuple[str, ...], limit: int = 2_000_000) -> list[Move]:
    """A cheapest sequence of moves (kind, label, transition); ties by the order in which moves are found."""
    start = model.initial()
    if start is None:
        raise NoAlignment("the model has an empty language")
    count = itertools.count()
    best, queue = {(start, 0): (0, None, None)}, [(0, next(count), start, 0)]
    done = set()
    while queue:
        cost, _, state, at = heapq.heappop(queue)
        if (state, at) in done:
            continue
        done.add((state, at))
        if len(done) > limit:
            raise RuntimeError(f"more than {limit} states in an alignment")
        on = model.enabled(state)
        if not on and at == len(trace):
            return moves_to(best, (state, at))
        options: list[tuple[int, Move, object, int]] = []
        for t in on:
            label, after = model.label(t), None
            after = model.fire(state, t)
            if label is None:
                options.append((SILENT_MOVE, ("silent", None, t), after, at))
            else:
                if at < len(trace) and trace[at] == label:
                    options.append((SYNCHRONOUS_MOVE, ("synchronous", label, t), after, at + 1))
                options.append((MODEL_MOVE, ("model", label, t), after, at))
        if at < len(trace):
            options.append((LOG_MOVE, ("log", trace[at], None), state, at + 1))
        for c, move, after, i in options:
            if (after, i) not in best or cost + c < best[after, i][0]:
                best[after, i] = (cost + c, (state, at), move)
                heapq.heappush(queue, (cost + c, next(count), after, i))
    raise NoAlignment("the model has no trace")


def moves_to(best: dict, at: tuple) -> list[Move]:
    out = []
    while best[at][1] is not None:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


def explain(model: Semantics, trace: list[str], balance: Fraction = Fraction(1), limit: int = 500_000) -> list[Move]:
    """The path to a final state that minimises (1 - probability of its transitions) times its alignment cost.

    ``balance`` is accepted and has no influence, as in the definition followed.
    """
    start, count = model.initial(), itertools.count()
    if start is None:
        raise NoAlignment("the model has an empty language")
    queue, seen = [(0.0, next(count), start, 0, Fraction(1), 0, ())], set()
    while queue:
        _, _, state, at, p, cost, path = heapq.heappop(queue)
        if (state, at) in seen:
            continue
        seen.add((state, at))
        if len(seen) > limit:
            raise RuntimeError(f"more than {limit} states in an explanation")
        on = model.enabled(state)
        if not on and at == len(trace):
            return list(path)
        total = sum((model.weight(t) for t in on), Fraction(0))
        options = []
        for t in on:
            label, q, after = model.label(t), model.weight(t) / total, model.fire(state, t)
            if label is None:
                options.append((q, SILENT_MOVE, ("silent", None, t), after, at))
            else:
                if at < len(trace) and trace[at] == label:
                    options.append((q, SYNCHRONOUS_MOVE, ("synchronous", label, t), after, at + 1))
                options.append((q, MODEL_MOVE, ("model", label, t), after, at))
        if at < len(trace):
            options.append((Fraction(1), LOG_MOVE, ("log", trace[at], None), state, at + 1))
        for q, c, move, after, i in options:
            heapq.heappush(queue, (float((1 - p * q) * (cost + c)), next(count), after, i, p * q, cost + c, (*path, move)))
    raise NoAlignment("the model has no trace")


def walk(model: Semantics, rng: random.Random) -> list[str] | None:
    """One random trace; a run that gets into a livelock begins again. None if every run would."""
    return step_out(model, rng) if any_traces(model) else None


def walks(model: Semantics, n: int, rng: random.Random) -> dict[tuple[str, ...], int] | None:
    """How often each trace comes in n random ones; the model is explored once. None if there is no trace."""
    known: dict = {}
    return dict(Counter(tuple(step_out(model, rng, known=known)) for _ in range(n))) if any_traces(model) else None


def step_out(model: Semantics, rng: random.Random, check_every: int = 1000, known: dict | None = None) -> list[str]:
    """One random trace of a model that has traces; ``known`` keeps what is enabled in the states met, of many walks."""
    start, known = model.initial(), {} if known is None else known
    state, trace, steps = start, [], 0
    while True:
        if (found := known.get(state)) is None:
            on = model.enabled(state)
            found = [(model.label(t), model.fire(state, t)) for t in on], list(itertools.accumulate(float(model.weight(t)) for t in on))
            if len(known) < MOST_KNOWN:
                known[state] = found
        after, upto = found
        if not after:
            break
        label, state = rng.choices(after, cum_weights=upto)[0]
        if label is not None:
            trace.append(label)
        steps += 1
        if steps % check_every == 0 and non_decreasing_livelock(model, state):
            state, trace = start, []
    return trace


def run_order(net, rng: random.Random, limit: int = 100_000) -> tuple[list[tuple[str, tuple[int, ...]]], bool]:
    """One random run of a net as a partial order: (events with their direct predecessors, whether the run ended).

    Each token knows the events it comes from; silent steps hand on what their inputs know.
    """
    tokens: list[list[frozenset]] = [[frozenset()] * n for n in net.marking]
    events: list[tuple[str, tuple[int, ...]]] = []
    above: list[frozenset] = []
    for _ in range(limit):
        on = net.enabled(tuple(map(len, tokens)))
        if not on:
            return events, True
        t = net.transitions[rng.choices(on, [float(net.weight(i)) for i in on])[0]]
        known = frozenset().union(*(tokens[p].pop(0) for p, n in t.inputs.items() for _ in range(n)))
        if t.label is not None:
            direct = known - frozenset().union(*(above[i] for i in known))
            above.append(frozenset().union(known, *(above[i] for i in known)))
            events.append((t.label, tuple(sorted(direct))))
            known = frozenset({len(events) - 1})
        for p, n in t.outputs.items():
            tokens[p] += [known] * n
    return events, False


def levenshtein(a: tuple, b: tuple) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def order_distance(a: list[tuple[str, tuple[int, ...]]], b: list[tuple[str, tuple[int, ...]]]) -> float:
    """Least edit distance between linearisations of two partial orders, by the length of the longer one.

    An order is a list of (activity, predecessors). Dijkstra over pairs of downward closed sets.
    """
    if not a and not b:
        return 0.0
    queue, seen, count = [(0, 0, frozenset(), frozenset())], set(), itertools.count(1)
    while queue:
        cost, _, x, y = heapq.heappop(queue)
        if (x, y) in seen:
            continue
        seen.add((x, y))
        if len(x) == len(a) and len(y) == len(b):
            return cost / max(len(a), len(b))
        ready = lambda o, d: [i for i, (_, pre) in enumerate(o) if i not in d and d.issuperset(pre)]
        left, right = ready(a, x), ready(b, y)
        for i in left:
            heapq.heappush(queue, (cost + 1, next(count), x | {i}, y))
        for j in right:
            heapq.heappush(queue, (cost + 1, next(count), x, y | {j}))
        for i in left:
            for j in right:
                heapq.heappush(queue, (cost + (a[i][0] != b[j][0]), next(count), x | {i}, y | {j}))
    raise ValueError("a partial order has a cycle")


def coded(*languages: list[tuple]) -> list[list[str]]:
    """The traces as strings of one code point per event, from one dictionary."""
    names = {a: chr(i if i < 0xD800 else i + 0x800) for i, a in enumerate(sorted({a for x in languages for t in x for a in t}))}
    return [["".join(map(names.__getitem__, t)) for t in x] for x in languages]


def earth_movers(a: dict[tuple, int], b: dict[tuple, int], distance=None) -> float:
    """1 - transport between two languages of counts; both are scaled to a common whole-numbered total."""
    if not a or not b:
        raise ValueError("a language is empty")
    left, right = list(a), list(b)
    cost = Normalised.of(*coded(left, right)) if distance is None else np.array([[distance(x, y) for y in right] for x in left])
    return 1 - moved(np.array([a[x] for x in left]), np.array([b[y] for y in right]), cost)


def moved(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray | Normalised, enough: float = -np.inf) -> float:
    """Least cost of turning one into the other, of each scaled to 1; what is below ``enough`` need not be the least."""
    s, d = int(supply.sum()), int(demand.sum())
    total = s * d // int(np.gcd(s, d))
    return transport(supply * (total // s), demand * (total // d), cost, enough * total) / total
