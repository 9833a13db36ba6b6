"""Line formats: a title line, then values one per line; lines that begin with # are comments."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

from ..models.objects import Alignment, FollowsGraph, Language, Order
from ..models.semantics import ONE, ZERO, Automaton, Edge, Net, Transition

TITLES = {
    "lang": "finite language",
    "slang": "finite stochastic language",
    "spolang": "finite stochastic partially ordered language",
    "dfm": "directly follows model",
    "sdfm": "stochastic directly follows model",
    "snfa": "stochastic non-deterministic finite automaton",
    "lpn": "labelled Petri net",
    "slpn": "stochastic labelled Petri net",
    "ali": "language of alignments",
    "sali": "stochastic language of alignments",
}


#: Lines around a value of several lines.
MARKS = ("$multiline", "multiline$")


class FormatError(ValueError):
    """The text is not of the format."""


class Lines:
    def __init__(self, text: str, title: str):
        self.rows = iter([x.strip() for x in text.splitlines() if not x.lstrip().startswith("#")])
        if (found := self.text()) != title:
            raise FormatError(f"expected '{title}', found '{found}'")

    def text(self) -> str:
        """A value; one over several lines stands between marks."""
        try:
            row = next(self.rows)
            if row == MARKS[0]:
                parts = []
                while (part := next(self.rows)) != MARKS[1]:
                    parts.append(part)
                row = "\n".join(parts)
            return row
        except StopIteration:
            raise FormatError("the file ends too early") from None

    def number(self) -> int:
        try:
            n = int(self.text())
        except ValueError as e:
            raise FormatError(str(e)) from None
        if n < 0:
            raise FormatError("a negative number")
        return n

    def fraction(self) -> Fraction:
        return fraction(self.text())

    def below(self, limit: int) -> int:
        n = self.number()
        if n >= limit:
            raise FormatError(f"{n} is out of range")
        return n

    def label(self) -> str | None:
        row = self.text()
        if row == "silent":
            return None
        if not row.startswith("label "):
            raise FormatError(f"expected a label, found '{row}'")
        return row[6:]

    def end(self) -> None:
        if any(self.rows):
            raise FormatError("text after the end")


def fraction(text: str | float) -> Fraction:
    try:
        return Fraction(str(text))
    except (ValueError, ZeroDivisionError) as e:
        raise FormatError(str(e)) from None


def read_lang(text: str) -> set[tuple[str, ...]]:
    rows = Lines(text, TITLES["lang"])
    return {tuple(rows.text() for _ in range(rows.number())) for _ in range(rows.number())}


def read_slang(text: str) -> Language:
    rows, out = Lines(text, TITLES["slang"]), {}
    for _ in range(rows.number()):
        p = rows.fraction()
        trace = tuple(rows.text() for _ in range(rows.number()))
        if p <= 0 or trace in out:
            raise FormatError("a probability that isn't positive, or a trace given twice")
        out[trace] = p
    if sum(out.values(), ZERO) > 1 + Fraction(1, 10**9):
        raise FormatError("the probabilities add up to more than 1")
    return out


def read_spolang(text: str) -> list[Order]:
    rows, out = Lines(text, TITLES["spolang"]), []
    for _ in range(rows.number()):
        p, n, events = rows.fraction(), rows.number(), []
        for _ in range(n):
            events.append((rows.text(), tuple(rows.below(n) for _ in range(rows.number()))))
        out.append(Order(events, p))
    return out


def weighted(row: str, stochastic: bool) -> tuple[str, Fraction]:
    head, mark, tail = row.partition("w")
    if bool(mark) != stochastic:
        raise FormatError(f"a weight is missing or out of place in '{row}'")
    return head, fraction(tail) if stochastic else ONE


def read_follows(text: str, stochastic: bool) -> FollowsGraph:
    rows = Lines(text, TITLES["sdfm" if stochastic else "dfm"])
    first = rows.text()
    if not stochastic and first not in ("true", "false"):
        raise FormatError("expected true or false")
    empty = fraction(first) if stochastic else Fraction(first == "true")
    names = [rows.text() for _ in range(rows.number())]
    out = FollowsGraph(list(dict.fromkeys(names)), empty)

    def at(text: str) -> str:
        if not text.isdigit() or int(text) >= len(names):
            raise FormatError(f"no node {text}")
        return names[int(text)]

    for to in (out.starts, out.ends):
        for _ in range(rows.number()):
            node, w = weighted(rows.text(), stochastic)
            if w <= 0 or at(node) in to:
                raise FormatError("a weight that isn't positive, or a node given twice")
            to[at(node)] = w
    for _ in range(rows.number()):
        pair, w = weighted(rows.text(), stochastic)
        a, mark, b = pair.partition(">")
        if not mark or w <= 0 or (at(a), at(b)) in out.edges:
            raise FormatError(f"no edge: '{pair}'")
        out.edges[at(a), at(b)] = w
    rows.end()
    return out


def read_snfa(text: str) -> Automaton:
    rows = Lines(text, TITLES["snfa"])
    first = rows.text()
    start = None if first in ("None", "none") else int(first)
    n, edges = rows.number(), []
    for _ in range(rows.number()):
        a, b, p = rows.below(n), rows.below(n), rows.fraction()
        edges.append(Edge(a, b, rows.label(), p))
    final = {s: rest for s in range(n) if (rest := ONE - sum((e.weight for e in edges if e.source == s), ZERO)) > 0}
    return Automaton(n, start, edges, final)


def read_net(text: str, stochastic: bool) -> Net:
    rows = Lines(text, TITLES["slpn" if stochastic else "lpn"])
    n = rows.number()
    marking, transitions = tuple(rows.number() for _ in range(n)), []
    for _ in range(rows.number()):
        t = Transition(rows.label(), weight=ONE)
        if stochastic:
            t.weight = rows.fraction()
        for arcs in (t.inputs, t.outputs):
            for _ in range(rows.number()):
                p = rows.below(n)
                arcs[p] = arcs.get(p, 0) + 1
        transitions.append(t)
    return Net(n, marking, transitions)


def read_alignments(text: str, stochastic: bool) -> list[Alignment]:
    rows, out = Lines(text, TITLES["sali" if stochastic else "ali"]), []
    for _ in range(rows.number()):
        weight, moves = rows.fraction() if stochastic else ONE, []
        for _ in range(rows.number()):
            kind = rows.text().removesuffix(" move")
            if kind not in ("synchronous", "log", "model", "silent"):
                raise FormatError(f"no kind of move: '{kind}'")
            label = None if kind == "silent" else rows.label()
            moves.append((kind, label, None if kind == "log" else rows.number()))
        out.append(Alignment(moves, weight))
    return out


def _rows(title: str, *parts: object) -> str:
    return "\n".join([title, *map(str, flat(parts))]) + "\n"


def flat(parts: object) -> Iterator[object]:
    for p in parts:
        if isinstance(p, (list, tuple)):
            yield from flat(p)
        elif isinstance(p, str) and "\n" in p:
            yield from (MARKS[0], p, MARKS[1])
        else:
            yield p


def write_lang(traces) -> str:
    rows = sorted(traces)
    return _rows(TITLES["lang"], "# number of traces", len(rows), [["# number of events", len(t), list(t)] for t in rows])


def write_slang(language: Language) -> str:
    return _rows(TITLES["slang"], "# number of traces", len(language), [["# probability", p, "# number of events", len(t), list(t)] for t, p in sorted(language.items())])


def write_spolang(orders: list[Order]) -> str:
    return _rows(TITLES["spolang"], "# number of traces", len(orders), [["# probability", o.probability, "# number of events", len(o.events), [[a, len(pre), list(pre)] for a, pre in o.events]] for o in orders])


def write_follows(g: FollowsGraph, stochastic: bool) -> str:
    number = {a: i for i, a in enumerate(g.activities)}
    w = lambda x: f"w{x}" if stochastic else ""
    one = lambda d: [len(d), [f"{number[a]}{w(x)}" for a, x in d.items()]]
    empty = g.empty if stochastic else str(g.empty > 0).lower()
    return _rows(TITLES["sdfm" if stochastic else "dfm"], "# empty traces", empty, "# activities", len(number), list(number), "# starts", one(g.starts), "# ends", one(g.ends), "# edges", len(g.edges), [f"{number[a]}>{number[b]}{w(x)}" for (a, b), x in g.edges.items()])


def named(label: str | None) -> str:
    return "silent" if label is None else f"label {label}"


def write_snfa(a: Automaton) -> str:
    return _rows(TITLES["snfa"], "# initial state", "None" if a.start is None else a.start, "# number of states", a.states, "# number of transitions", len(a.edges), [[e.source, e.target, e.weight, named(e.label)] for e in a.edges])


def write_net(net: Net, stochastic: bool) -> str:
    arcs = lambda d: [sum(d.values()), [p for p, n in d.items() for _ in range(n)]]
    each = [["# transition", named(t.label), [t.weight] * stochastic, "# inputs", arcs(t.inputs), "# outputs", arcs(t.outputs)] for t in net.transitions]
    return _rows(TITLES["slpn" if stochastic else "lpn"], "# number of places", net.places, "# initial marking", list(net.marking or [0] * net.places), "# number of transitions", len(net.transitions), each)


def write_alignments(rows: list[Alignment], stochastic: bool) -> str:
    move = lambda m: [f"{m[0]} move", [] if m[0] == "silent" else named(m[1]), [] if m[2] is None else m[2]]
    return _rows(TITLES["sali" if stochastic else "ali"], "# number of alignments", len(rows), [[[a.weight] * stochastic, "# number of moves", len(a.moves), [move(m) for m in a.moves]] for a in rows])
