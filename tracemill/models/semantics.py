"""Process models as labelled transition systems.

Two kinds of object carry all formats: nets (places, transitions, weights) and automata (states, edges, probabilities).
Trees, partially ordered models and diagrams become nets, directly-follows models and languages become automata. A state is
a hashable value, a transition has an index, a label (None: silent) and a weight; a state is final if nothing is enabled.
Numbers are exact fractions.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Hashable, Iterable
from dataclasses import dataclass, field
from fractions import Fraction
from typing import Protocol

State = Hashable
ONE, ZERO = Fraction(1), Fraction(0)


class TooManyStates(RuntimeError):
    """A search exceeded its limit; the model may be unbounded."""


class Semantics(Protocol):
    def initial(self) -> State | None: ...
    def enabled(self, state: State) -> list[int]: ...
    def fire(self, state: State, transition: int) -> State: ...
    def label(self, transition: int) -> str | None: ...
    def weight(self, transition: int) -> Fraction: ...


@dataclass
class Transition:
    label: str | None
    inputs: dict[int, int] = field(default_factory=dict)
    outputs: dict[int, int] = field(default_factory=dict)
    weight: Fraction = ONE


@dataclass
class Net:
    """A labelled Petri net; with ``marking`` None its language is empty."""

    places: int
    marking: tuple[int, ...] | None
    transitions: list[Transition]

    def initial(self) -> State | None:
        return self.marking

    def enabled(self, state: State) -> list[int]:
        return [i for i, t in enumerate(self.transitions) if all(state[p] >= n for p, n in t.inputs.items()) and t.weight > 0]

    def fire(self, state: State, transition: int) -> State:
        after, t = list(state), self.transitions[transition]
        for p, n in t.inputs.items():
            after[p] -= n
        for p, n in t.outputs.items():
            after[p] += n
        return tuple(after)

    def label(self, transition: int) -> str | None:
        return self.transitions[transition].label

    def weight(self, transition: int) -> Fraction:
        return self.transitions[transition].weight

    def alphabet(self) -> set[str]:
        return {t.label for t in self.transitions if t.label is not None}

    def add_place(self, tokens: int = 0) -> int:
        self.places += 1
        self.marking = (*(self.marking or ()), tokens)
        return self.places - 1

    def add(self, label: str | None, inputs: Iterable[int], outputs: Iterable[int], weight: Fraction = ONE) -> int:
        count = lambda xs: {p: sum(q == p for q in xs) for p in xs}
        self.transitions.append(Transition(label, count(list(inputs)), count(list(outputs)), weight))
        return len(self.transitions) - 1


class Indexed:
    """A net for searches: states hold the marked places only, and what is enabled is looked up by them, so that a step costs
    what it touches instead of all places and transitions. Transitions keep their numbers and order."""

    def __init__(self, net: Net):
        self.marking, self.transitions = net.marking, net.transitions
        self.free = [i for i, t in enumerate(net.transitions) if not t.inputs and t.weight > 0]
        self.takers: dict[int, list[int]] = {}
        for i, t in enumerate(net.transitions):
            if t.weight > 0:
                for p in t.inputs:
                    self.takers.setdefault(p, []).append(i)

    def initial(self) -> State | None:
        return None if self.marking is None else tuple((p, n) for p, n in enumerate(self.marking) if n)

    def enabled(self, state: State) -> list[int]:
        marked = dict(state)
        asked = {i for p in marked for i in self.takers.get(p, ())}
        return sorted([*self.free, *(i for i in asked if all(marked.get(p, 0) >= n for p, n in self.transitions[i].inputs.items()))])

    def fire(self, state: State, transition: int) -> State:
        after, t = dict(state), self.transitions[transition]
        for p, n in t.inputs.items():
            after[p] = after.get(p, 0) - n
        for p, n in t.outputs.items():
            after[p] = after.get(p, 0) + n
        return tuple(sorted((p, n) for p, n in after.items() if n))

    def label(self, transition: int) -> str | None:
        return self.transitions[transition].label

    def weight(self, transition: int) -> Fraction:
        return self.transitions[transition].weight


@dataclass
class Edge:
    source: int
    target: int
    label: str | None
    weight: Fraction = ONE


@dataclass
class Automaton:
    """States 0 to n-1; ``final`` gives the probability (or, without probabilities, the weight 1) of ending in a state.

    Ending is a silent transition of its own: numbers from ``len(edges)`` on stand for it, one per state.
    """

    states: int
    start: int | None
    edges: list[Edge]
    final: dict[int, Fraction]
    END = "end"

    def __post_init__(self) -> None:
        self.leaving: list[list[int]] = [[] for _ in range(self.states)]
        for i, e in enumerate(self.edges):
            if e.weight > 0:
                self.leaving[e.source].append(i)

    def initial(self) -> State | None:
        return self.start

    def enabled(self, state: State) -> list[int]:
        if state == self.END:
            return []
        return self.leaving[state] + [len(self.edges) + state] * (self.final.get(state, ZERO) > 0) or [-1]

    def fire(self, state: State, transition: int) -> State:
        return state if transition < 0 else self.END if transition >= len(self.edges) else self.edges[transition].target

    def label(self, transition: int) -> str | None:
        return self.edges[transition].label if 0 <= transition < len(self.edges) else None

    def weight(self, transition: int) -> Fraction:
        return ONE if transition < 0 else self.edges[transition].weight if transition < len(self.edges) else self.final[transition - len(self.edges)]

    def alphabet(self) -> set[str]:
        return {e.label for e in self.edges if e.label is not None}

    def deterministic(self) -> bool:
        return all(len({self.edges[i].label for i in out}) == len(out) and all(self.edges[i].label is not None for i in out) for out in self.leaving)


@dataclass
class Graph:
    """The reachable states of a model: ``edges[s]`` lists (transition, probability, next state)."""

    states: list[State]
    edges: list[list[tuple[int, Fraction, int]]]

    def predecessors(self) -> list[set[int]]:
        out: list[set[int]] = [set() for _ in self.states]
        for s, es in enumerate(self.edges):
            for _, _, t in es:
                out[t].add(s)
        return out

    def reaching(self, goals: Iterable[int]) -> set[int]:
        before, seen, todo = self.predecessors(), set(goals), deque(goals)
        while todo:
            for s in before[todo.popleft()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def finals(self) -> list[int]:
        return [s for s, es in enumerate(self.edges) if not es]

    def livelocks(self) -> set[int]:
        """States from which no final state can be reached."""
        return set(range(len(self.states))) - self.reaching(self.finals())

    def components(self) -> list[int]:
        """The number of each state's strongly connected component, in reverse topological order."""
        n, order, low, comp, stack, count, time = len(self.states), {}, {}, [-1] * len(self.states), [], 0, 0
        for root in range(n):
            if root in order:
                continue
            work = [(root, iter(self.edges[root]))]
            order[root] = low[root] = time
            time += 1
            stack.append(root)
            while work:
                v, it = work[-1]
                for _, _, w in it:
                    if w not in order:
                        order[w] = low[w] = time
                        time += 1
                        stack.append(w)
                        work.append((w, iter(self.edges[w])))
                        break
                    if comp[w] < 0:
                        low[v] = min(low[v], order[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == order[v]:
                        while True:
                            w = stack.pop()
                            comp[w] = count
                            if w == v:
                                break
                        count += 1
        return comp


def explored(model: Semantics, limit: int = 100_000) -> Graph:
    start = model.initial()
    if start is None:
        return Graph([], [])
    index, states, edges, at = {start: 0}, [start], [], 0
    while at < len(states):
        on = model.enabled(states[at])
        total = sum((model.weight(t) for t in on), ZERO)
        out = []
        for t in on:
            after = model.fire(states[at], t)
            if after not in index:
                if len(states) >= limit:
                    raise TooManyStates(f"more than {limit} states")
                index[after] = len(states)
                states.append(after)
            out.append((t, model.weight(t) / total, index[after]))
        edges.append(out)
        at += 1
    return Graph(states, edges)


def any_traces(model: Semantics) -> bool:
    """Whether the language has a trace: there is an initial state that is no livelock."""
    graph = explored(model)
    return bool(graph.states) and 0 not in graph.livelocks()


def infinitely_many_traces(model: Semantics) -> bool:
    """Whether a visible edge lies on a cycle from which a final state can be reached."""
    graph = explored(model)
    comp, dead = graph.components(), graph.livelocks()
    return any(s not in dead and comp[s] == comp[t] and model.label(i) is not None for s, es in enumerate(graph.edges) for i, _, t in es)


def bounded(net: Semantics, limit: int = 100_000) -> bool:
    """Karp and Miller: unbounded iff a marking strictly covers one on its path; automata and trees are bounded."""
    if not isinstance(net, Net) or net.marking is None:
        return True
    todo, seen = [(net.marking, ())], set()
    while todo:
        marking, path = todo.pop()
        if any(all(a >= b for a, b in zip(marking, m, strict=True)) and marking != m for m in path):
            return False
        if marking in seen:
            continue
        seen.add(marking)
        if len(seen) > limit:
            raise TooManyStates(f"more than {limit} markings")
        todo += [(net.fire(marking, t), (*path, marking)) for t in net.enabled(marking)]
    return True


def non_decreasing_livelock(model: Semantics, state: State, limit: int = 10_000) -> bool:
    """Whether every way on from a state is forced into a loop that never ends."""
    seen = set()
    while state not in seen:
        if len(seen) >= limit:
            raise TooManyStates(f"more than {limit} states")
        seen.add(state)
        on = model.enabled(state)
        if not on:
            return False
        if len(on) > 1:
            sub = Started(model, state)
            return 0 in explored(sub, limit).livelocks()
        state = model.fire(state, on[0])
    return True


@dataclass
class Started:
    """A model from another initial state."""

    model: Semantics
    state: State

    def initial(self) -> State:
        return self.state

    def __getattr__(self, name: str):
        return getattr(self.model, name)
