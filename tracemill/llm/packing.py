"""Vector best-fit packing of token sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). Pieces come in
decreasing length, and each goes to the open sequence that fits best under every constraint: by the least weighted norm
of the residual capacities left, or by the largest weighted dot product of the piece's demand with them.

Pieces of one length are alike, so the plan is made from the count per length: at most ``capacity`` numbers, whatever the
size of the corpus. Sequences with the same content are one group with a count, and placing a length into groups splits
them. The result is a table of runs; a piece finds its place from its rank among the pieces of its length, which is a sum
of counts per partition. So the packing is the same global best fit as piece by piece, and no group of equal lengths ever
meets in one task.

Defined results: a null text is empty; an empty text is one piece of the end mark; repeated rows are packed each; an empty
table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import map_rows, own_names, table, written

CAPACITY, END_ID = 4096, 1
#: Pieces whose ids a worker remembers, in each of two generations: more memory, less encoding.
KNOWN_WORDS = 500_000
#: What may be told of a piece, from its ids as little-endian 32-bit bytes: kind of column and value.
PAYLOAD = {"ids": ("array<int>", lambda own: np.frombuffer(own, "<i4")), "ids_crc32": ("bigint", zlib.crc32)}
#: The normalizer and splitter that pieces between spaces may be encoded apart under, as tokenizer files say them.
BY_PIECES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
RUN = np.dtype([("length", "i8"), ("rank", "i8"), ("per", "i8"), ("sequence", "i8"), ("offset", "i8")])


class Words(dict):
    """Token ids of pieces between spaces, as little-endian 32-bit bytes.

    Two generations bound the memory: when the young one is full it becomes the old one, from which words in use return.
    A piece of Latin letters goes straight to the tokenizer's model, without a full stop or comma at its end, which the
    splitter parts from it anyway; any other piece goes through the whole tokenizer. All this holds under the normalizer and
    splitter in :data:`BY_PIECES`; ``apart`` tells whether the tokenizer has them.
    """

    def __init__(self, path: str, most: int):
        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.apart = (told["normalizer"], told["pre_tokenizer"]) == BY_PIECES and all("<" in t["content"] for t in told["added_tokens"])
        self.model, level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) == chr(c).lower()]
        same = [c for c in letters if c not in "ªº"]
        self.mapped = {ord(c): level.pre_tokenize_str(c)[0][0] for c in same}
        self.letters = frozenset(same)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.found(word)
        self[word] = ids
        return ids

    def found(self, word: str) -> bytes:
        body, mark = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
        lower = body.lower()
        if lower and self.letters.issuperset(lower) and len(lower) == len(body) and max(body) < "\u0100":
            ids = array("I", [t.id for t in self.model.tokenize(lower if lower.isascii() else lower.translate(self.mapped))]).tobytes()
            return ids + self[mark] if mark else ids
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


@functools.lru_cache(maxsize=2)
def words(path: str, most: int = KNOWN_WORDS) -> Words:
    return Words(path, most)


def encoded(text: str | None, known: Words) -> bytes:
    """The ids of the whole text.

    A tokenizer whose normalizer and splitter never look across a space or line end encodes the pieces between, any other
    one the text as a whole. Texts of the first 256 characters are lowered first, as the normalizer would, so that fewer pieces differ; not so with
    a ``<``, as special tokens are told by their case.
    """
    text = text or ""
    if not known.apart:
        return array("I", known.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    if "<" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, payload: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text", known_words: int = KNOWN_WORDS) -> DataFrame:
    """(id, piece, start, length, *payload, _part, _rank): the pieces, and each one's rank in its partition and length.

    The payload has any of ``ids`` (array of the piece's token ids) and ``ids_crc32`` (CRC-32 of them, 32-bit
    little-endian).
    """
    end = int(end_id).to_bytes(4, "little")

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        known, part, seen = words(tokenizer, known_words), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            out: dict[str, list] = {k: [] for k in (id_col, "piece", "start", "length", *payload, "_part", "_rank")}
            for doc, text in zip(b[id_col], b[text_col], strict=True):
                data = encoded(text, known) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    n = len(own) // 4
                    values = [PAYLOAD[p][1](own) for p in payload]
                    for k, v in zip(out, (doc, piece, at // 4, n, *values, part, int(seen[n])), strict=True):
                        out[k].append(v)
                    seen[n] += 1
            yield out

    own = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f"{p} {PAYLOAD[p][0]}, " for p in payload)
    return map_rows(own_names(docs, [id_col, text_col]), work, f"`{id_col}` {own}, piece int, start long, length long, {kinds}_part int, _rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm") -> np.ndarray:
    """Runs of a best fit decreasing: pieces of ``length`` from ``rank`` on go to sequences from ``sequence`` on, ``per`` to
    each, the first of them at ``offset``. A piece that no empty sequence can hold raises ValueError."""
    limit = np.array([capacity, max_docs or capacity, max_cost or float(capacity) ** 2], dtype=float)
    if counts and (max(counts) > capacity or max(counts) ** 2 > limit[2]):
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    weight = np.array(weights)
    runs: list[tuple[int, int, int, int, int]] = []
    left, first, many = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, np.int64)  # residuals, first sequence, how many
    sequences, lengths = 0, sorted(counts, reverse=True)
    for length in lengths:
        count, rank = counts[length], 0
        demand = np.array([length, 1, float(length) ** 2])
        open_ = (left[:, 0] >= lengths[-1]) & (left[:, 1] >= 1)
        left, first, many = left[open_], first[open_], many[open_]
        while count:
            fits = np.flatnonzero((left >= demand).all(axis=1))
            if len(fits):
                after = (left[fits] - demand) / limit
                rating = (weight * after**2).sum(axis=1) if score == "norm" else -(weight * (demand / limit) * (left[fits] / limit)).sum(axis=1)
                g = fits[np.lexsort((first[fits], rating))[0]]
                room, start, own = left[g].copy(), int(first[g]), int(many[g])
                per = int(np.floor(room / demand).min())
            else:
                g, room, start = None, limit.copy(), sequences
                per = int(np.floor(room / demand).min())
                own = -(-count // per)
                sequences += own
            full, rest = divmod(min(count, own * per), per)
            pieces = [(full, per)] * bool(full) + [(1, rest)] * bool(rest)
            kept = []
            at = start
            for bins, each in pieces:
                runs.append((length, rank, each, at, int(capacity - room[0])))
                kept.append((room - each * demand, at, bins))
                at, rank, count = at + bins, rank + bins * each, count - bins * each
            if at < start + own:
                kept.append((room, at, start + own - at))
            if g is not None:
                keep = np.arange(len(first)) != g
                left, first, many = left[keep], first[keep], many[keep]
            left = np.concatenate([left, np.array([k[0] for k in kept])])
            first, many = np.concatenate([first, [k[1] for k in kept]]), np.concatenate([many, [k[2] for k in kept]])
    return np.sort(np.array(runs, dtype=RUN), order=["length", "rank"])


def placed(pieces: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """``pieces`` (written, with length, _part and _rank) with sequence_id and offset, without the helper columns."""
    counts = pieces.groupBy("_part", "length").agg(F.count("*").alias("n"))
    base = counts.select("_part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_base"))
    totals = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # one row per length: capacity at most
    runs = pieces.sparkSession.sparkContext.broadcast(plan(totals, capacity, **options))
    ranked = pieces.join(base, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    kept = [c for c in pieces.columns if c not in ("_part", "_rank")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = runs.value
        shift = 1 << 44
        order = table_["length"] * shift + table_["rank"]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            r = table_[np.searchsorted(order, length * shift + rank, "right") - 1]
            k = rank - r["rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(r["sequence"] + k // r["per"]), pa.array(r["offset"] + k % r["per"] * length)], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.mapInArrow(work, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, payload: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text", known_words: int = KNOWN_WORDS, **options) -> DataFrame:
    """(id, piece, start, length, *payload, sequence_id, offset) per piece; options go to :func:`plan`."""
    return placed(written(tokenized(docs, tokenizer, capacity, end_id, payload, id_col, text_col, known_words), "pieces"), capacity, **options)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer(), payload=("ids_crc32",))
