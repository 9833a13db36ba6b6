"""SimHash near copies by similarity: sampled bits propose groups, and the Jaccard similarity of word shingles decides.

Operator 9 with a limit in similarity instead of bits. Every text gets the set of its word shingles as 64-bit hashes, and
a fingerprint of 256 bits: each is 1 if set in over half of the set's hashes, of 64 bits and as many mixed from them, three
times. The first 128 are sampled and tabled, the others only tell apart what these leave. Equal sets collapse first, so copies are never compared. A pair of similarity s has a cosine of 2 s / (1 + s) and so differs in a
bit with probability acos(2 s / (1 + s)) / pi, 0.152 at 0.8, which 3 bits, and five blocks for them, can't reach. So
distinct fingerprints meet in buckets of equal samples of their bits. A sample has as many bits as keep buckets small
however many fingerprints there are, and there are as many samples as let a pair of similarity 0.8 share none with
probability ``MISS``. Samples are taken ``ROUND`` at a time, and a round's shuffle is deleted before the next, so that disk
holds a round whatever the number of samples. Inside a bucket each fingerprint has a row in a distance table, as in operator
9: its Hamming distances to references. Pairs are made in the order of the first coordinate, those beyond ``MOST_BITS`` in
any coordinate are discarded, and of the others those of which more than ``MOST_BITS`` of 128 bits differ (19.4 are expected
at 0.8, with a deviation of 4.1; 64 of unlike texts), or more than ``MOST_OF_ALL`` of 256 (38.9 and 5.7; 128). As distances
to a reference spread by 5.6 bits, a coordinate discards a pair only where one of it lies near the reference, so references
are chosen among fingerprints too. The more fingerprints there are, the more unlike pairs of a bucket are within 128 bits'
limit, as they share the bits of its sample: of 236,000 fingerprints such pairs chained 11,907 to one group, of 708,000
73,772, and the texts of a group are copied to all its chunks. By both limits these groups have 859 and 874. What is left
joins rows to loose groups; the texts of a group meet once, in pairs made from the distance table again, and those that nothing has
joined yet are decided by their whole sets.
Buckets and groups over ``bucket_rows`` are split into chunks whose pairs go to separate tasks.

Defined results: a null, empty or blank text has the empty set, and all such texts are alike; texts of fewer words than a
shingle are one shingle; the rest is as in :mod:`simhash`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, own_names, settled, written
from .graph import components
from .simhash import BITS, SAMPLE, SEED, dealt, linking, representatives, widest

#: Similarity asked for, the chance to miss such a pair, most differing bits, also of all bits, and fingerprints that a bucket expects.
ALIKE, MISS, MOST_BITS, MOST_OF_ALL, EXPECTED = 0.8, 0.002, 38, 65, 16
#: Samples of bits whose keys are on disk at once, and references of a distance table.
ROUND, REFERENCES = 16, 8
#: How hashes are mixed to further ones: by a shift and a factor each.
MIXES = [(np.uint64(31), np.uint64(0x9E3779B97F4A7C15)), (np.uint64(29), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB))]
#: The fingerprint's columns.
SKETCH = ["s0", "s1", "s2", "s3"]


def shingles(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The hashes of the text's shingles, sorted, each once."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(shingle_words, len(words))
    each = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, itertools.repeat(SEED)), dtype=np.uint64, count=len(words) - n + 1))


def sketch(own: np.ndarray) -> list[int]:
    """The fingerprint of a set of hashes, as signed numbers."""
    ones = np.zeros((len(SKETCH), BITS), np.int64)
    for at in range(0, len(own), 8192):
        h = own[at : at + 8192]
        for k, part in enumerate((h, *((h ^ (h >> shift)) * factor for shift, factor in MIXES))):
            ones[k] += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(own), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def differing(similarity: float) -> float:
    """The share of bits in which sets of a similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def samples(n: int, seed: int = 9) -> list[tuple[int, int]]:
    """Masks of the bits that make a key, for so many fingerprints."""
    same = 1 - differing(ALIKE)
    bits = max(8, round(math.log2(max(n, 1) / EXPECTED)))
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(2 * BITS, bits, replace=False).tolist() for _ in range(math.ceil(math.log(MISS) / math.log(1 - same**bits)))]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [(signed(sum(1 << b for b in c if b < BITS)), signed(sum(1 << (b - BITS) for b in c if b >= BITS))) for c in chosen]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity is 0.8 at least, in whole numbers."""
    if 4 * max(len(a), len(b)) > 5 * min(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (len(a) + len(b))


def sketches(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, th, s0, s1, s2, s3): fp is a hash of the set of shingles, th of the whole text, the others are the fingerprint."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            sets = [shingles(t, shingle_words) for t in b[text_col]]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            made = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(SKETCH))
            yield {id_col: b[id_col], "fp": fps, "th": b["th"]} | {name: made[:, k] for k, name in enumerate(SKETCH)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(own_names(docs, [id_col, text_col]).withColumn("th", F.xxhash64(text_col)), work, f"`{id_col}` {kind}, fp long, th long, {', '.join(f'{name} long' for name in SKETCH)}")


def rounds(n: int) -> list[list[tuple[int, tuple[int, int]]]]:
    """The numbered masks for so many fingerprints, ``ROUND`` at a time."""
    numbered = list(enumerate(samples(n)))
    return [numbered[at : at + ROUND] for at in range(0, len(numbered), ROUND)]


def buckets(each: DataFrame, numbered: list[tuple[int, tuple[int, int]]]) -> DataFrame:
    """(key, fp, s0, s1, s2, s3): every fingerprint once for each of the samples of its bits."""
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, (a, b) in numbered])
    key = F.xxhash64("m.k", F.col("s0").bitwiseAND(F.col("m.a")), F.col("s1").bitwiseAND(F.col("m.b")))
    return each.select("fp", *SKETCH, F.explode(masks).alias("m")).select(key.alias("key"), "fp", *SKETCH)


def distances(s0: np.ndarray, s1: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The distance table: a row per fingerprint, a column per reference."""
    return np.bitwise_count(s0[:, None] ^ refs[None, :, 0]).astype(np.int16) + np.bitwise_count(s1[:, None] ^ refs[None, :, 1])


def references(each: DataFrame, n: int = REFERENCES, seed: int = 20) -> np.ndarray:
    """References as two numbers each, from random ones and a bounded sample, chosen as operator 9 does."""
    sample = each.select("s0", "s1").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas().to_numpy(np.int64).reshape(-1, 2).view(np.uint64)
    drawn = np.random.default_rng(seed).integers(0, 1 << 64, (4 * n, 2), dtype=np.uint64)
    offered = np.concatenate([drawn, sample[: 4 * n]])
    return np.concatenate([offered[widest(distances(sample[:, 0], sample[:, 1], offered), n)], drawn])[:n]


def apart(i: np.ndarray, j: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    """In how many bits of these parts of fingerprints i and j differ."""
    return sum(np.bitwise_count(s[i] ^ s[j]).astype(np.int16) for s in parts)


def proposed(
    key: np.ndarray, fp: np.ndarray, s0: np.ndarray, s1: np.ndarray, side: np.ndarray, refs: np.ndarray, s2: np.ndarray | None = None, s3: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) inside runs of equal keys, from the distance table, of which at most ``MOST_BITS`` bits differ, and with
    the rest of the fingerprint ``MOST_OF_ALL``."""
    s0, s1, *rest = (s.view(np.uint64) for s in (s0, s1, s2, s3) if s is not None)
    rows = distances(s0, s1, refs)
    order = np.lexsort((rows[:, 0], key))
    key, s0, s1, rest, side, rows = key[order], s0[order], s1[order], [s[order] for s in rest], side[order], rows[order]
    a, b, at, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(fp)), rows[:, 0]
    for step in itertools.count(1):
        at = at[at + step < len(fp)]
        at = at[(key[at] == key[at + step]) & (first[at + step] - first[at] <= MOST_BITS)]
        if not len(at):
            return np.concatenate(a), np.concatenate(b)
        keep = at[(side[at] == 2) | (side[at] != side[at + step])]
        keep = keep[np.abs(rows[keep, 1:] - rows[keep + step, 1:]).max(axis=1, initial=0) <= MOST_BITS]
        keep = keep[apart(keep, keep + step, s0, s1) <= MOST_BITS]
        keep = keep[apart(keep, keep + step, s0, s1, *rest) <= MOST_OF_ALL]
        a.append(order[keep])
        b.append(order[keep + step])


def decided(
    key: np.ndarray, fp: np.ndarray, s0: np.ndarray, s1: np.ndarray, text: np.ndarray, side: np.ndarray, shingle_words: int, refs: np.ndarray, **rest: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) inside runs of equal keys whose sets are alike, of those that the distance table makes; what is joined
    already is not compared."""
    a, b = [], []
    edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
    for lo, hi in itertools.pairwise(edges):
        i, j = proposed(key[lo:hi], fp[lo:hi], s0[lo:hi], s1[lo:hi], side[lo:hi], refs, **{name: s[lo:hi] for name, s in rest.items()})
        if not len(i):
            continue
        i, j = np.minimum(i, j), np.maximum(i, j)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        first, group, sets = np.searchsorted(i, np.arange(hi - lo + 1)), np.arange(hi - lo), [shingles(t, shingle_words) for t in text[lo:hi]]
        for x in range(hi - lo):
            others = j[first[x] : first[x + 1]]
            for y in others[group[others] != group[x]]:
                if group[y] != group[x] and alike(sets[x], sets[y]):
                    a.append(lo + x)
                    b.append(lo + int(y))
                    group[group == group[y]] = group[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1024) -> DataFrame:
    """(id, fp, th, root, component_id) per row; root names the component, component_id is the smallest id of a row reachable over pairs that are alike."""
    marks = written(sketches(docs, shingle_words, id_col, text_col), "sketches")
    each = written(marks.groupBy("fp").agg(F.min(id_col).alias("least"), F.min(F.struct(F.col(id_col).alias("_id"), "th")).alias("one"), *[F.min(s).alias(s) for s in SKETCH]), "distinct")
    refs, links = references(each), None
    for numbered in rounds(each.count()):
        found = written(linking(dealt(buckets(each, numbered), bucket_rows), lambda **c: proposed(**c, refs=refs), 1 << 16), "links")
        links = found if links is None else links.union(found)
        settled(docs.sparkSession)
    loose = components(links).withColumnsRenamed({"node": "fp", "root": "key"})
    # rows and members meet on one column, so that a shuffle of the texts by it also serves what drops their copies
    members = written(each.join(loose, "fp").select("key", "fp", *SKETCH, F.struct(F.col("one._id").alias("id"), "one.th").alias("one")), "loose")
    texts = own_names(docs, [id_col, text_col]).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("row"), F.col(text_col).alias("text"))
    told = written(texts.join(members, texts["row"] == members["one"]).dropDuplicates(["one"]).select("key", "fp", *SKETCH, "text"), "members")  # a row, not all its copies
    settled(docs.sparkSession)
    roots = written(components(linking(dealt(told, bucket_rows), lambda **c: decided(**c, shingle_words=shingle_words, refs=refs), 2 * bucket_rows)), "roots")
    settled(docs.sparkSession)
    named = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that the joins' sides are plain shuffles, of which a hot component's or fingerprint's part can be split
    best = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return marks.join(named.join(best, "root").select("fp", "root", "component_id"), "fp").select(id_col, "fp", "th", "root", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as of :func:`simhash.one_of_each`, by similarity."""
    return representatives(docs, near_duplicates(docs, shingle_words, id_col, text_col), id_col, text_col)
