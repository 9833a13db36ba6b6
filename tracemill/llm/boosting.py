"""Gradient-boosted regression trees for two classes, in numpy: logistic loss, exact splits on few distinct values."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Each tree is heap-ordered: node i has children 2i+1 and 2i+2; a feature of -1 marks a leaf."""

    depth: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[rows, np.maximum(f, 0)] > cut[at]
                at = np.where(f < 0, at, 2 * at + 1 + right)
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int, ridge: float) -> tuple[int, float]:
    """Feature and cut of the largest gain; feature -1 where no split leaves ``least`` rows on both sides."""
    best, at, total = 1e-9, (-1, 0.0), g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ends = np.flatnonzero(v[1:] > v[:-1])
        ends = ends[(ends + 1 >= least) & (len(v) - ends - 1 >= least)]
        if len(ends):
            gain = cg[ends] ** 2 / (ch[ends] + ridge) + (cg[-1] - cg[ends]) ** 2 / (ch[-1] - ch[ends] + ridge) - total
            if gain.max() > best:
                k = ends[gain.argmax()]
                best, at = gain.max(), (f, float(v[k] + v[k + 1]) / 2)
    return at


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5, ridge: float = 1.0) -> Trees:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model, size = Trees(depth, float(np.log(p / (1 - p)))), 2 ** (depth + 1) - 1
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        feature, cut, value, at = np.full(size, -1), np.zeros(size), np.zeros(size), np.zeros(len(y), dtype=np.int64)
        for node in range(size):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            value[node] = rate * g[own].sum() / (h[own].sum() + ridge)
            if 2 * node + 2 < size:
                feature[node], cut[node] = best_split(x[own], g[own], h[own], least, ridge)
                if feature[node] >= 0:
                    at[own] = 2 * node + 1 + (x[own, feature[node]] > cut[node])
        margin += value[at]
        model.trees.append((feature, cut, value))
    return model


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray, steps: int = 50) -> Trees:
    """Platt scaling by Newton's method on rows the trees haven't seen."""
    m, t = model.margin(x), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        d, w = q - t, np.maximum(q * (1 - q), 1e-9)
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, np.array([(d * m).sum(), d.sum()]))
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model
