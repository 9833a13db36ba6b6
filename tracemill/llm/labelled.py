"""What the two classifiers share: who may be learnt from, bounded samples, and calibration."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows

#: Labels that may be broadcast to the documents, as rows; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
FOLDS = 5
#: Most bytes of text that a model is fitted on.
SAMPLE_BYTES = 64 << 20


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that no label is learnt from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_labels(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y): one label per id that may be learnt from; of contradicting ones the larger."""
    own = labels.select(labels[id_col], labels[label_col].cast("int").alias("y")).where(~held_out(id_col) & F.col("y").isNotNull() & F.col(id_col).isNotNull())
    return own.groupBy(id_col).agg(F.max("y").alias("y"))


def class_sizes(labels: DataFrame) -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in labels.groupBy("y").count().collect()}  # two rows


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, text, y) of at most so many labelled ids of each class, chosen by a hash of the id, and of so many bytes of text.

    An id gives one row, however many rows of ``docs`` carry it: the text with the least hash. Rows that would exceed the
    bytes are left out whole; the running sum goes over the bounded rows only.
    """
    ids = [labels.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n) for y, n in rows_per_class.items()]
    joined = with_labels(docs, ids[0].unionByName(ids[1]), sum(rows_per_class.values()), id_col, text_col)
    rows = joined.groupBy(id_col).agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    rows = rows.select(F.col(id_col).alias("id"), "text", "y", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    so_far = F.sum("size").over(W.partitionBy().orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).select("id", "text", "y")


def with_labels(docs: DataFrame, labels: DataFrame, n_labels: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of the labelled documents; broadcasts the labels only up to a checked number."""
    own = docs.select(docs[id_col], docs[text_col].alias("text"))
    return own.join(F.broadcast(labels) if n_labels <= BROADCAST_LABELS else labels, id_col)


def fitted(rows: DataFrame, fit: Callable[[Iterator[tuple[str | None, int]]], object]) -> object:
    """Runs ``fit`` over the bounded sample in one task on an executor and returns what it makes."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        order = sorted((d, t or "", y) for b in batches for d, t, y in zip(b["id"], b["text"], b["y"], strict=True))
        yield {"model": [pickle.dumps(fit((t, y) for _, t, y in order))]}

    own = rows.select(F.xxhash64("id").alias("id"), "text", "y")
    made = map_rows(own.repartition(1), work, "model binary").first()
    return pickle.loads(made[0]) if made else fit(iter([]))  # no task runs where no labelled row is there


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve through weighted labelled margins, by Newton's method."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    scale = float(np.abs(margin).max()) or 1.0
    m = margin / scale
    up, down = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log(up / down))

    def loss(a: float, b: float) -> float:
        z = a * m + b
        return float((weight * (np.logaddexp(0, z) - t * z)).sum()) + 0.5e-3 * a * a

    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        d, w = weight * (q - t), np.maximum(weight * q * (1 - q), 1e-12)
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(d * m).sum() + 1e-3 * a, d.sum()]))
        size, before = 1.0, loss(a, b)
        while size > 1e-4 and loss(a - size * step[0], b - size * step[1]) > before:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-9:
            break
    return max(float(a) / scale, 1e-6), float(b)


def logistic(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
