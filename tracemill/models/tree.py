"""Process trees, their translation to nets, reduction and structural questions."""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

from .semantics import ONE, Net

OPERATORS = ("xor", "sequence", "concurrent", "or", "interleaved", "loop")


@dataclass
class Tree:
    """A node: an operator with children, ``activity`` with a label, or ``tau``. Leaves may carry weights; the root of a
    stochastic tree carries the weight of ending in ``ending``."""

    kind: str
    label: str | None = None
    children: list[Tree] = field(default_factory=list)
    weight: Fraction = ONE
    ending: Fraction = ONE

    def __str__(self) -> str:
        return self.label if self.kind == "activity" else "tau" if self.kind == "tau" else f"{self.kind}({', '.join(map(str, self.children))})"

    def leaves(self) -> list[Tree]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]

    def alphabet(self) -> set[str]:
        return {x.label for x in self.leaves() if x.kind == "activity"}


TAU = Tree("tau")


def activity(label: str) -> Tree:
    return Tree("activity", label)


def node(kind: str, children: list[Tree]) -> Tree:
    return Tree(kind, None, children)


def net_of(tree: Tree | None) -> Net:
    """A net with the tree's language: one token goes from the start place to the end place, where it is consumed."""
    net = Net(0, (), [])
    if tree is None:
        return Net(0, None, [])
    start, end = net.add_place(1), net.add_place()
    translate(net, tree, start, end)
    net.add(None, [end], [], tree.ending)
    return net


def translate(net: Net, tree: Tree, a: int, b: int) -> None:
    """Adds the tree between places a and b; b is reached once per token in a."""
    kind, children = tree.kind, tree.children
    if kind in ("activity", "tau"):
        net.add(tree.label if kind == "activity" else None, [a], [b], tree.weight)
    elif kind == "xor":
        for c in children:
            translate(net, c, a, b)
    elif kind == "sequence":
        at = a
        for i, c in enumerate(children):
            after = b if i == len(children) - 1 else net.add_place()
            translate(net, c, at, after)
            at = after
    elif kind == "loop":
        body, done = net.add_place(), net.add_place()
        net.add(None, [a], [body])
        translate(net, children[0], body, done)
        for c in children[1:]:
            translate(net, c, done, body)
        net.add(None, [done], [b])
    elif kind in ("concurrent", "interleaved", "or"):
        starts, ends = [net.add_place() for _ in children], [net.add_place() for _ in children]
        if kind == "or":
            # child by child a silent choice: run or skip; the last may not be skipped if all others were
            at = {False: a}
            for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
                last = i == len(children) - 1
                after = {True: net.add_place()} | ({} if last else {False: net.add_place()})
                for some, place in at.items():
                    net.add(None, [place], [after[True], s])
                    if some or not last:
                        net.add(None, [place], [after[some], e])
                at = after
            net.add(None, [*ends, at[True]], [b])
        else:
            net.add(None, [a], starts)
            net.add(None, ends, [b])
        if kind == "interleaved":
            lock = net.add_place()
            net.transitions[-2].outputs[lock] = 1
            net.transitions[-1].inputs[lock] = 1
            inner = [(net.add_place(), net.add_place()) for _ in children]
            for (s, e), (x, y) in zip(zip(starts, ends, strict=True), inner, strict=True):
                net.add(None, [s, lock], [x])
                net.add(None, [y], [e, lock])
            starts, ends = [x for x, _ in inner], [y for _, y in inner]
        for c, s, e in zip(children, starts, ends, strict=True):
            translate(net, c, s, e)
    else:
        raise ValueError(f"unknown operator {kind}")


def empty_traces(tree: Tree) -> bool:
    """Whether the empty trace is in the language."""
    if tree.kind in ("activity", "tau"):
        return tree.kind == "tau"
    if tree.kind in ("xor", "or"):
        return any(map(empty_traces, tree.children))
    return empty_traces(tree.children[0]) if tree.kind == "loop" else all(map(empty_traces, tree.children))


def infinitely_many(tree: Tree) -> bool:
    return bool(tree.alphabet()) if tree.kind == "loop" else any(map(infinitely_many, tree.children))


def reduced(tree: Tree) -> Tree:
    """Rewrites to a smaller tree of the same language until nothing changes."""
    while True:
        after = step(Tree(tree.kind, tree.label, [reduced(c) for c in tree.children], tree.weight, tree.ending))
        if str(after) == str(tree):
            return after
        tree = after


def step(tree: Tree) -> Tree:
    kind, children = tree.kind, tree.children
    if not children:
        return tree
    if len(children) == 1 and kind != "loop":
        return children[0]  # an operator over one child
    if kind in ("xor", "sequence", "concurrent", "or"):
        flat = [g for c in children for g in (c.children if c.kind == kind else [c])]  # associativity
        if len(flat) != len(children):
            return node(kind, flat)
    taus = [c for c in children if c.kind == "tau"]
    if kind in ("sequence", "concurrent", "interleaved") and taus:  # silent steps say nothing there
        rest = [c for c in children if c.kind != "tau"]
        return node(kind, rest) if rest else Tree("tau")
    if kind in ("xor", "or") and taus:
        rest = [c for c in children if c.kind != "tau"]
        if not rest:
            return Tree("tau")
        if any(map(empty_traces, rest)):
            return node(kind, rest)
        if len(taus) > 1:
            return node(kind, [*rest, Tree("tau")])
    if kind == "loop":
        if all(c.kind == "tau" for c in children):
            return Tree("tau")
        first, redo = children[0], children[1:]
        if first.kind == "loop" and len(redo) == 1 and redo[0].kind == "tau":
            return first if any(empty_traces(c) for c in first.children[1:]) else tree
        if first.kind == "tau" and len(redo) > 1:
            return node("loop", [first, node("xor", redo)])
        if len(redo) == 1 and redo[0].kind == "xor" and first.kind != "tau":
            return node("loop", [first, *redo[0].children])
    if kind == "interleaved" and all(len(c.leaves()) == 1 and c.kind == "activity" for c in children):
        return node("concurrent", children)  # single steps interleave anyway
    return tree


def with_weights(tree: Tree, weight_of) -> Tree:
    """A stochastic tree: each leaf gets ``weight_of(label)``."""
    return Tree(tree.kind, tree.label, [with_weights(c, weight_of) for c in tree.children], ONE if tree.children else Fraction(weight_of(tree.label)), tree.ending)
