"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-grams: words, and n-grams of one to three of its tokens' shapes, each hashed to a bucket. The
class log-count ratios of the buckets are counted over all rows that may be learnt from, summed in each task before the
shuffle. A linear hinge-loss model is then fitted by dual coordinate descent to the indicators scaled by these ratios, on
a bounded sample (``rows_per_class``, :data:`labelled.SAMPLE_BYTES`), its weights are interpolated with their mean size as usual for this model, and
margins are calibrated on rows of the sample that were kept back.

Defined results: a null or empty text has no n-grams and scores by the calibration's shift alone; without labels of both
classes every score is that of the class seen, and 1 without any, as no document is dropped on no evidence; of several texts
with one id, all count for the ratios and the one with the least hash is fitted; repeated rows score alike; an empty table
gives an empty one; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, own_names, table
from .labelled import class_sizes, fitted, held_out, logistic, platt, sample, training_labels, with_labels

#: Most rows of each class that the hinge-loss model is fitted on.
ROWS_PER_CLASS = {1: 4000, 0: 4000}
BUCKETS, MOST_TOKENS = 1 << 18, 300_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
REPEAT = zlib.crc32(b"again")


def shape(token: str) -> str:
    """Punctuation stands for itself, shortened; words for their case and for digits in them."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    kind = "A" if token.isupper() and len(token) > 1 else "a" if token.islower() else "Aa" if token[0].isupper() else "x"
    return kind + ("0" if any(c.isdigit() for c in token) else "")


class Tokens(dict):
    """(bucket of the word, number of the shape) by token, packed in an integer; emptied when it gets large."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MOST_TOKENS:
            self.clear()
        word, form = zlib.crc32(token.lower().encode()), zlib.crc32(shape(token).encode())
        self[token] = found = (word % BUCKETS) << 32 | form
        return found


KNOWN = Tokens()


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the whole text's n-grams."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(0, np.int64)
    packed = np.fromiter(map(KNOWN.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    word, form = packed >> 32, (packed & 0xFFFFFFFF).astype(np.uint64)
    form[1:][packed[1:] == packed[:-1]] = REPEAT
    mixed = [form * np.uint64(0x9E3779B97F4A7C15)]
    for _ in range(2):
        if len(mixed[-1]) > 1:
            mixed.append((mixed[-1][:-1] ^ (form[len(mixed) :] + np.uint64(len(mixed)))) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(np.concatenate([word, *(np.unique(m >> np.uint64(46)).astype(np.int64) for m in mixed)]))


def ratios(texts: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratio per bucket, from all rows of ``texts(text, y)``; as many numbers as there are buckets."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                sums[int(y > 0), indicators(text)] += 1
        seen = np.flatnonzero(sums.any(axis=0))
        yield {"bucket": seen.tolist(), "no": sums[0, seen].tolist(), "yes": sums[1, seen].tolist()}

    found = map_rows(texts.select("text", "y"), work, "bucket int, no long, yes long").groupBy("bucket").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toPandas()
    counts = np.full((2, BUCKETS), alpha)
    counts[:, found["bucket"]] += found[["no", "yes"]].to_numpy().T
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0]).astype(np.float32)


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, epochs: int = 30, tolerance: float = 1e-3, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine; each step solves one dual variable exactly."""
    weight, bias, dual = np.zeros(width), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = y[i] * (weight[rows[i]] @ values[i] + bias) - 1
            bound = min(slope, 0) if dual[i] <= 0 else max(slope, 0) if dual[i] >= cost[i] else slope
            worst = max(worst, abs(bound))
            if bound:
                new = min(max(dual[i] - slope / square[i], 0), cost[i])
                step = (new - dual[i]) * y[i]
                weight[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
        if worst < tolerance:
            break
    return weight, bias


@dataclass
class Model:
    """``weight`` holds the ratios times the hinge-loss weights: what an indicator adds to the margin."""

    weight: np.ndarray
    bias: float
    ratio: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str | None) -> float:
        at = indicators(text)
        size = float(np.sqrt((self.ratio[at] ** 2).sum())) or 1.0
        return float(self.weight[at].sum()) / size + self.bias

    def score(self, text: str | None) -> float:
        return float(logistic(self.slope * self.margin(text) + self.shift))


def train(texts: Iterable[tuple[str, int]], ratio: np.ndarray, weights: dict[int, float], cost: float = 1.0, blend: float = 0.25) -> Model:
    rows, y = [], []
    for text, label in texts:
        rows.append(indicators(text))
        y.append(1 if label > 0 else -1)
    y = np.array(y, dtype=float)
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, ratio, 0.0, -40.0 if len(y) and y[0] < 0 else 40.0)
    values = []
    for at in rows:
        v = ratio[at].astype(float)
        values.append(v / (np.sqrt(v @ v) or 1.0))
    kept = np.arange(len(rows)) % 5 != 4
    kept = kept if len(set(y[kept])) == 2 and len(set(y[~kept])) == 2 else np.ones(len(rows), bool)
    use = np.flatnonzero(kept)
    each = np.where(y > 0, 0.5 / (y[use] > 0).mean(), 0.5 / (y[use] < 0).mean()) * cost
    weight, bias = dual_descent([rows[i] for i in use], [values[i] for i in use], y[use], each[use], BUCKETS)
    active = np.flatnonzero(weight)
    level = np.abs(weight[active]).mean() if len(active) else 0.0
    weight[active] = (1 - blend) * level * np.sign(weight[active]) + blend * weight[active]
    model = Model((weight * ratio).astype(np.float32), bias, ratio)
    held = np.flatnonzero(~kept) if (~kept).any() else use
    margin = np.array([model.weight[rows[i]].sum() / (np.sqrt((ratio[rows[i]].astype(float) ** 2).sum()) or 1.0) + bias for i in held])
    model.slope, model.shift = platt(margin, (y[held] > 0).astype(float), np.array([weights[int(v > 0)] for v in y[held]]))
    return model


def model_of(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    bound = rows_per_class or ROWS_PER_CLASS
    known = training_labels(labels, label_col, id_col)
    sizes = class_sizes(known)
    weights = {y: max(1.0, sizes.get(y, 0) / n) for y, n in bound.items()}
    if not sizes:
        return train([], np.zeros(BUCKETS, np.float32), weights)
    ratio = ratios(with_labels(docs, known, sum(sizes.values()), id_col, text_col))
    chosen = sample(docs, known, bound, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS floats: 1 MB
    return fitted(chosen, lambda rows: train(rows, shared.value, weights, **options))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The documents with the score of the whole text, from 0 to 1; all other columns are kept, or those in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two floats per bucket: 2 MB
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            yield {c: b[c] for c in kept} | {score_col: [shared.value.score(t) for t in b[text_col]]}

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return map_rows(own_names(docs, list(dict.fromkeys([*kept, text_col]))), work, f"{kinds}`{score_col}` double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, model_of(docs, table(spark, sf_dir, "labels"), "quality"), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
