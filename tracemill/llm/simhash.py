"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint. Equal fingerprints collapse first, so copies are never compared. Distinct ones meet
in buckets: of five blocks of bits, two are equal whenever at most three bits differ, so the ten pairs of blocks lose no
link. Inside a bucket each fingerprint has a row in a distance table: its Hamming distances to many reference
fingerprints, chosen on a bounded sample so that distances to them spread. By the triangle inequality a pair within the
limit differs by no more than the limit in any coordinate. So pairs are made from the table: rows are put in the order of
the first coordinate, and each meets only those within the limit of it; pairs beyond the limit in any other coordinate are
discarded, and the survivors are verified.

A bucket of over ``bucket_rows`` is dealt to cells of the first coordinates, a step wider than the limit; a row goes to its
own cell and to those neighbouring cells, greater than its own, that hold rows within the limit, so any such pair still
meets. A cell that is still too large is split into chunks whose pairs go to separate tasks. Each task returns only links
of every fingerprint to the least one that it reaches there, never all pairs. Components come from Spark joins over these
links.

Defined results: a null, empty or blank text has fingerprint zero, which links like any other; texts of fewer words than
a shingle are one shingle; repeated rows give repeated results; null ids never become a component's id unless a component
has no other; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, own_names, set_aside, table, written
from .graph import components

BITS, SEED = 64, 42
#: Coordinates that oversized buckets are dealt by, and fingerprints that references are chosen on.
CELL_COORDINATES, SAMPLE = 3, 1024


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = shingle_words
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) > n else iter([b" ".join(words)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), dtype=np.uint64, count=max(1, len(words) - n + 1))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, th): fp is the fingerprint as a signed long, th a hash of the whole text."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for b in batches:
            fps = [fingerprint(t, shingle_words) for t in b[text_col]]
            yield {id_col: b[id_col], "fp": [f - (1 << 64) if f >> 63 else f for f in fps], "th": b["th"]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(own_names(docs, [id_col, text_col]).withColumn("th", F.xxhash64(text_col)), work, f"`{id_col}` {kind}, fp long, th long")


def block_masks(distance: int) -> list[int]:
    """Masks of block pairs: with distance + 2 blocks, two of them are equal in any pair within the distance."""
    n = distance + 2
    edges = [BITS * i // n for i in range(n + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    return [block[i] | block[j] for i, j in itertools.combinations(range(n), 2)]


def pivots(n: int, seed: int = 20) -> np.ndarray:
    """Reference fingerprints: none of the bits, then random halves."""
    return np.concatenate([np.zeros(1, np.uint64), np.random.default_rng(seed).integers(0, 1 << 64, n - 1, dtype=np.uint64)])


def distance_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def spread_pivots(fps: DataFrame, n: int) -> np.ndarray:
    """References, the one with the widest spread of distances first, then by what a coordinate adds to those before it."""
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    offered = np.concatenate([pivots(4 * n), sample[: 4 * n]])
    return np.concatenate([offered[widest(distance_table(sample, offered), n)], pivots(n)])[:n]


def widest(table: np.ndarray, n: int) -> list[int]:
    """The columns of a distance table, at most n, that spread most, each by what it adds to those before it."""
    rest, chosen = table.astype(float), []
    rest -= rest.mean(axis=0) if len(table) else 0
    while len(chosen) < n and len(table) and (spread := (rest**2).sum(axis=0)).max() > 1e-6:
        chosen.append(int(spread.argmax()))
        own = rest[:, chosen[-1]].copy()
        rest -= np.outer(own, own @ rest / (own @ own))
    return chosen


def linked(key: np.ndarray, fp: np.ndarray, side: np.ndarray, guest: np.ndarray, distance: int, refs: np.ndarray, examined: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (i, j) inside runs of equal keys. Sides: 0 compares with 1, 2 with all; guests with none of their own.

    ``examined`` gets the number of pairs that the first coordinate made.
    """
    rows = distance_table(fp, refs)
    order = np.lexsort((rows[:, 0], key))
    key, fp, side, guest, rows, a, b = key[order], fp[order], side[order], guest[order], rows[order].astype(np.int8), [], []
    first, at = rows[:, 0], np.arange(len(fp))
    for step in itertools.count(1):
        at = at[at + step < len(fp)]
        at = at[(key[at] == key[at + step]) & (first[at + step] - first[at] <= distance)]
        if not len(at):
            break
        i, j = at, at + step
        own = ((side[i] == 2) | (side[i] != side[j])) & ~(guest[i] & guest[j])
        i, j = i[own], j[own]
        if examined is not None:
            examined.append(len(i))
        for k in range(1, refs.size, 8):  # the coordinates in groups: most pairs fall in the first
            keep = np.abs(rows[i, k : k + 8] - rows[j, k : k + 8]).max(axis=1, initial=0) <= distance
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        a.append(order[i[keep]])
        b.append(order[j[keep]])
    return (np.concatenate(a), np.concatenate(b)) if a else (at, at)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that links lead to."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == before).all():
            return least


def oversized(rows: DataFrame, most: int) -> DataFrame:
    """(key, chunks) of the keys of over ``most`` rows."""
    return written(rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("chunks")), "large")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with side, sorted by key in their partitions; keys of over ``most`` rows are split into pairs of chunks."""
    large = oversized(rows, most)
    names, plain = [c for c in rows.columns if c != "key"], rows.withColumn("side", F.lit(2))
    if not large.isEmpty():
        marked = rows.join(large, "key", "left")
        own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
        hot = marked.where("chunks is not null").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).cast("int")
        hot = hot.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *names, side.alias("side"))
        plain = marked.where("chunks is null").select("key", *names, F.lit(2).alias("side")).unionByName(hot)
    return plain.repartition("key").sortWithinPartitions("key")


def in_cells(rows: DataFrame, most: int, distance: int, refs: np.ndarray) -> DataFrame:
    """``rows(key, fp)`` with guest; keys of over ``most`` rows are dealt to cells of the first coordinates."""
    large = oversized(rows, most)
    if large.isEmpty():
        return rows.withColumn("guest", F.lit(False))
    marked, step = rows.join(large.select("key", F.lit(1).alias("hot")), "key", "left"), distance + 1
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(r)))) for r in refs[:CELL_COORDINATES].view(np.int64)]
    hot = marked.where("hot is not null").select("key", "fp", F.array(*[F.floor(d / step).cast("int") for d in far]).alias("home"), *[F.sequence(F.floor((d - distance) / step).cast("int"), F.floor((d + distance) / step).cast("int")).alias(f"c{k}") for k, d in enumerate(far)])
    for k in range(len(far)):
        hot = hot.withColumn(f"c{k}", F.explode(f"c{k}"))
    cell = F.array(*[f"c{k}" for k in range(len(far))])
    hot = hot.withColumn("cell", cell).where("cell >= home").select(F.xxhash64("key", "cell").alias("key"), "fp", (F.col("cell") > F.col("home")).alias("guest"))
    return marked.where("hot is null").select("key", "fp", F.lit(False).alias("guest")).unionByName(hot)


def linking(rows: DataFrame, work: Callable[..., tuple[np.ndarray, np.ndarray]], batch_rows: int) -> DataFrame:
    """Links (a, b) that ``work`` finds in runs of whole keys, given the columns as arrays, as a forest of stars."""
    names = ["key", *(c for c in rows.columns if c != "key")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = dict(zip(names, map(np.concatenate, zip(*parts, strict=True)), strict=True))
            fp = columns["fp"]
            least = forest(len(fp), *work(**columns))
            own = np.flatnonzero(least != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[least[own]])], names=["a", "b"])

        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in names])
                if sum(len(h[0]) for h in held) >= batch_rows:
                    parts = [np.concatenate(x) for x in zip(*held, strict=True)]
                    cut = int(np.searchsorted(parts[0], parts[0][-1]))  # the last run may go on
                    if cut:
                        yield done([[p[:cut] for p in parts]])
                    held = [[p[cut:] for p in parts]]
        if held:
            yield done(held)

    return rows.select(*names).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def links(fps: DataFrame, distance: int = 3, n_pivots: int = 32, bucket_rows: int = 2048, batch_rows: int = 1 << 16) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to join all that are within ``distance`` bits of each other.

    ``fps`` has one row per fingerprint in column fp. Ten rows are made of each; in an oversized bucket as many more as
    there are neighbouring cells (8 on average, 14 at most), and in an oversized cell as many more as it has chunks.
    """
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m)
    rows = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(signed(m))) for i, m in enumerate(block_masks(distance))])).alias("key"))
    refs = spread_pivots(fps, n_pivots)
    rows = in_cells(rows, bucket_rows, distance, refs)
    return linking(dealt(rows, bucket_rows), lambda key, fp, guest, side: linked(key, fp.view(np.uint64), side, guest, distance, refs), batch_rows)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, th, root, component_id) per row; root names the component, component_id is the smallest id of a row reachable over links."""
    marks = written(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    each = written(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = written(components(links(each, distance)), "roots")
    named = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that the joins' sides are plain shuffles, of which a hot component's or fingerprint's part can be split
    best = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return marks.join(named.join(best, "root").select("fp", "root", "component_id"), "fp").select(id_col, "fp", "th", "root", "component_id")


def one_of_each(docs: DataFrame, shingle_words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, but of each component only the one with the smallest id, and that once; of several
    texts with this id in one component the one with the least hash. Components that share an id are told apart."""
    return representatives(docs, near_duplicates(docs, shingle_words, distance, id_col, text_col), id_col, text_col)


def representatives(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that :func:`one_of_each` keeps, given the components found."""
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.first("component_id").alias("component_id"), F.min("th").alias("th"))
    # one column on both sides, so that the join's shuffle of the documents also serves what drops their copies
    kept = kept.select(F.struct(F.col("component_id").alias("id"), "th").alias("_kept"))
    own, back = set_aside(docs, ["_row", "_kept"])
    marked = own.withColumn("_row", F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")))
    return back(marked.join(kept, marked["_row"] == kept["_kept"], "left_semi").dropDuplicates(["_row"]).drop("_row")).select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
