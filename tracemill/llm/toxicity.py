"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of itself, so misspelt and inflected words that were
never seen share vectors with those that were. The vector of each word goes through a linear softmax, and a document's
log odds are the exponential mean of its words' log odds: a mean, so that a text doesn't become toxic by being long or by
being repeated, but one in which an insult counts for more than the clean words around it. Embeddings and softmax are
trained together by Adam: first on plain means over whole documents, then on exponential means.

The sample to learn from is bounded by ``rows_per_class`` and :data:`labelled.SAMPLE_BYTES`; scores come from the whole
text and nothing else.

Defined results: a null or empty text scores as one word without letters; without labels of both classes every score is
that of the class seen, and 0 without any, as no document is called toxic on no evidence; of several texts with one id that
is learnt from, the one with the least hash is taken; repeated rows score alike; an empty table gives an empty one; further
columns are not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, own_names, set_aside, table
from .decontaminate import words_of
from .labelled import class_sizes, fitted, held_out, logistic, platt, sample, training_labels

#: Most rows of each class that the model is fitted on.
ROWS_PER_CLASS = {1: 1200, 0: 1800}
BUCKETS, WIDTH, SHORT, LONG = 1 << 16, 8, 3, 6
MOST_WORDS = 150_000
#: Words hashed at once, and their bytes, which bound the memory of a step; a longer word is a part of its own.
PART, PART_BYTES = 30_000, 1 << 20
#: The word of a text without words.
NOTHING = [b""]


def parts(words: list[bytes]) -> list[tuple[int, int]]:
    """Begin and end of the parts that the words are hashed in."""
    cuts, held = [0], 0
    for i, w in enumerate(words):
        if i > cuts[-1] and (i - cuts[-1] == PART or held + len(w) + 2 > PART_BYTES):
            cuts.append(i)
            held = 0
        held += len(w) + 2
    return list(itertools.pairwise([*cuts, len(words)])) if words else []


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word): the buckets of the words' character n-grams, with marked ends, and of the words themselves; at most
    ``PART`` words, so that both fit 16 bits.

    An n-gram is hashed as a polynomial of its characters, so all words are hashed together, length by length, in slices of
    ``PART_BYTES`` characters that overlap by an n-gram.
    """
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    marked = [f"<{w.decode()}>" for w in words]
    data = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    word, ends, buckets, owners = np.repeat(np.arange(len(words), dtype=np.uint16), size), np.cumsum(size), [], []
    for at in range(0, len(data), PART_BYTES):
        own_data = data[at : at + PART_BYTES + LONG - 1].astype(np.uint64)
        owner = word[at : at + PART_BYTES]
        left, mixed = ends[owner] - np.arange(at, at + len(owner)), own_data.copy()
        for n in range(2, min(LONG, len(own_data)) + 1):
            mixed[: len(own_data) - n + 1] += own_data[n - 1 :] * np.uint64(pow(0x100000001B3, n - 1, 1 << 64))
            if n >= SHORT:
                own = np.flatnonzero(left >= n)
                buckets.append((((mixed[own] + np.uint64(n << 50)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16))
                owners.append(owner[own])
    buckets.append(np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)).astype(np.uint16))
    owners.append(np.arange(len(words), dtype=np.uint16))
    return np.concatenate(buckets), np.concatenate(owners)


def pooled(m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponential mean of each run of ``m`` that begins at ``first``, what each value weighs in its run)."""
    n = np.diff(np.append(first, len(m)))
    run = np.repeat(np.arange(len(first)), n)
    top = np.maximum.reduceat(m, first)
    share = np.exp(m - top[run])
    total = np.add.reduceat(share, first)
    return top + np.log(total / n), share / total[run]


@dataclass
class Model:
    """Embeddings, the softmax's columns and biases, and the calibration of the document's margin."""

    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    words: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": {}}

    def gram_scores(self) -> np.ndarray:
        return self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])

    def learn(self, words: set[bytes], scores: np.ndarray) -> None:
        """Adds what the words say to those known; when they get too many, all but these are forgotten."""
        if len(self.words) + len(words) > MOST_WORDS:
            self.words.clear()
        new = list(words - self.words.keys())
        for begin, end in parts(new):
            part = new[begin:end]
            bucket, word = grams(part)
            mean = np.bincount(word, scores[bucket], minlength=len(part)) / np.bincount(word, minlength=len(part))
            self.words.update(zip(part, mean.tolist(), strict=True))

    def margins(self, texts: list[str | None], scores: np.ndarray) -> np.ndarray:
        """Per text the exponential mean of its words' log odds; by linearity a word's are the mean of its n-grams' own."""
        split = [words_of(t) or NOTHING for t in texts]
        if not split:
            return np.zeros(0)
        self.learn(set().union(*split), scores)
        sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        own = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(split)), dtype=np.float64, count=int(sizes.sum()))
        return pooled(own, np.cumsum(sizes) - sizes)[0] + float(self.bias[1] - self.bias[0])


@dataclass
class Sample:
    """Texts to learn from, as numbers of words: (words, buckets, owners) of each part, n-grams per word, words in order."""

    hashed: list[tuple[slice, np.ndarray, np.ndarray]]
    size: np.ndarray
    word: np.ndarray
    lengths: np.ndarray
    y: np.ndarray

    def __post_init__(self) -> None:
        self.first = np.cumsum(self.lengths) - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)

    def margins(self, model: Model) -> np.ndarray:
        """The log odds of every word."""
        scores = model.gram_scores()
        scores = np.concatenate([np.bincount(w, scores[g], minlength=k.stop - k.start) for k, g, w in self.hashed]) / self.size
        return scores[self.word] + model.bias[1] - model.bias[0]

    def gradients(self, model: Model, weight: np.ndarray, plain: bool, decay: float) -> list[np.ndarray]:
        """Of the weighted logistic loss by embeddings, softmax and biases; over plain or exponential means."""
        m = self.margins(model)
        margin, share = (np.add.reduceat(m, self.first) / self.lengths, 1 / self.lengths[self.doc]) if plain else pooled(m, self.first)
        pull = weight * (logistic(margin) - self.y)  # of the loss by the margin
        by_word = np.bincount(self.word, pull[self.doc] * share, minlength=len(self.size)) / self.size
        by_gram = sum((np.bincount(g, by_word[k][w], minlength=BUCKETS) for k, g, w in self.hashed), np.zeros(BUCKETS))
        turn = model.embedding.T @ by_gram
        return [np.outer(by_gram, model.softmax[:, 1] - model.softmax[:, 0]) + decay * model.embedding, np.stack([-turn, turn], axis=1), np.array([-pull.sum(), pull.sum()])]


def sample_of(rows: Iterable[tuple[str, int]]) -> Sample:
    vocabulary: dict[bytes, int] = {}
    texts, y = [], []
    for text, label in rows:
        texts.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text) or NOTHING], dtype=np.int32))
        y.append(float(label))
    every = list(vocabulary)
    hashed = [(slice(a, b), *grams(every[a:b])) for a, b in parts(every)]
    size = np.concatenate([np.bincount(w, minlength=k.stop - k.start) for k, _, w in hashed])
    return Sample(hashed, size, np.concatenate(texts), np.array([len(t) for t in texts]), np.array(y))


def train(rows: Iterable[tuple[str, int]], weights: dict[int, float], epochs: tuple[int, int] = (20, 80), rate: float = 0.05, decay: float = 1e-5, seed: int = 11) -> Model:
    """Full-batch Adam. A fifth of the rows is kept back for the calibration."""
    rows, rng = list(rows), np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, WIDTH)), np.stack([np.full(WIDTH, -0.1), np.full(WIDTH, 0.1)], axis=1) + rng.normal(0, 0.02, (WIDTH, 2)), np.zeros(2))
    classes = {int(y) for _, y in rows}
    if len(classes) < 2:
        model.embedding[:] = 0
        model.slope, model.shift = 0.0, 40.0 if 1 in classes else -40.0
        return model
    sample = sample_of(rows)
    y, kept = sample.y, np.arange(len(rows)) % 5 != 4
    del rows
    kept = kept if len(set(y[kept])) == 2 and len(set(y[~kept])) == 2 else np.ones(len(y), bool)
    balance = np.where(y > 0, 0.5 / max(y[kept].sum(), 1), 0.5 / max((1 - y)[kept].sum(), 1)) * kept
    parameters = (model.embedding, model.softmax, model.bias)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    for step in range(1, sum(epochs) + 1):
        for p, g, (a, b) in zip(parameters, sample.gradients(model, balance, step <= epochs[0], decay), moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    margin, held = pooled(sample.margins(model), sample.first)[0], ~kept if (~kept).any() else kept
    model.slope, model.shift = platt(margin[held], y[held], np.array([weights[int(v)] for v in y[held]]))
    model.embedding = model.embedding.astype(np.float32)
    return model


def model_of(docs: DataFrame, labels: DataFrame, label_col: str, rows_per_class: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    bound = rows_per_class or ROWS_PER_CLASS
    known = training_labels(labels, label_col, id_col)
    sizes = class_sizes(known)
    weights = {y: max(1.0, sizes.get(y, 0) / n) for y, n in bound.items()}
    if not sizes:
        return train([], weights)
    return fitted(sample(docs, known, bound, id_col, text_col), lambda rows: train(rows, weights, **options))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The documents with the score of the whole text, from 0 to 1; all other columns are kept, or those in ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH floats: 2 MB
    kept = [c for c in (docs.columns if keep is None else keep) if c != score_col]

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        m = shared.value
        scores = m.gram_scores()
        for b in batches:
            yield {c: b[c] for c in kept} | {score_col: logistic(m.slope * m.margins(b[text_col], scores) + m.shift).tolist()}
        m.words.clear()  # the worker may live on

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return map_rows(own_names(docs, list(dict.fromkeys([*kept, text_col]))), work, f"{kinds}`{score_col}` double")


def accepted(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.5, **options) -> DataFrame:
    """The documents, all columns kept, that score below the threshold."""
    own, back = set_aside(docs, ["_score"])
    found = scored(own, model_of(docs, labels, label_col, **options), score_col="_score")
    return back(found.where(F.col("_score") < threshold).drop("_score")).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, model_of(docs, table(spark, sf_dir, "labels"), "toxic"), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
