"""Sharding by balanced label propagation.

Documents that belong together are given as links (row, group): a group is a hyperedge, and an ordinary edge is a group
of two. Every linked row starts in the shard of its home, the least hash of the groups within a few links of it, so that most
neighbours start together. Each round counts, per group, its rows in each shard, adds up what the
groups of a row say, and lets the row ask for the shard where most of its neighbours are; only open shards can be asked
for, and rounds alternate between moves up and moves down, so that two rows never swap for ever. How many of those that
ask may move follows from the capacities: a table of counts by origin, target and gain goes to the driver (a few thousand
rows at most), which grants a share of each cell, highest gain first. All else are Spark joins and sums; a group with a
third of all rows is summed on the map side and spreads over as many shards as it needs.

Rows without links then fill the shards up, and a distributed ranking along the shards, and in them along the homes,
gives slots; its cuts make the numbers of rows of any two shards at most one apart (the ``rows`` law). A cut parts the rows
of one group at most, so of groups that share no rows no more are cut than there are cuts, and a group that needs several
shards takes neighbouring ones.

Defined results: a null text is empty; repeated rows are sharded each; null ids are ids like any other; an empty table
gives an empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, own_names, table, written

GAINS = 8  # steps of the gain's binary logarithm that the grants tell apart


def granted(asked: np.ndarray, load: np.ndarray, capacity: float, rounds: int = 100) -> np.ndarray:
    """The share of each cell (origin, target, gain) that may move, such that no load exceeds the capacity.

    Starts from all and takes back, lowest gain first, what overfills a target; what stays at its origin then is counted
    there again, until nothing changes.
    """
    share = np.where(asked > 0, 1.0, 0.0)
    for _ in range(rounds):
        moved = asked * share
        leave, enter = moved.sum(axis=(1, 2)), moved.sum(axis=(0, 2))
        room = np.maximum(0, capacity - (load - leave))
        if (enter <= room + 1e-9).all():
            break
        for t in np.flatnonzero(enter > room):
            left = room[t]
            for g in range(asked.shape[2] - 1, -1, -1):
                want = moved[:, t, g].sum()
                fit = min(1.0, left / want) if want else 1.0
                share[:, t, g] *= fit
                left -= want * fit
    safe: set[int] = set()
    while True:  # where it has not settled, into what is too full goes only what fits if nothing leaves it
        moved = asked * share
        leave, enter = moved.sum(axis=(1, 2)), moved.sum(axis=(0, 2))
        full = [t for t in np.flatnonzero(enter > np.maximum(0, capacity - (load - leave)) + 1e-9) if t not in safe]
        if not full:
            return share
        for t in full:
            share[:, t] *= min(1.0, max(0.0, capacity - load[t]) / enter[t])
        safe.update(full)


def homes(links: DataFrame, reach: int) -> DataFrame:
    """(id, home): the least hash of the groups that ``reach`` links lead to; written. Groups that share no rows need none."""
    found = written(links.groupBy("id").agg(F.min(F.xxhash64("grp")).alias("home"), F.count("*").alias("groups")), "homes")
    several = (found.agg(F.max("groups")).first()[0] or 0) > 1
    for _ in range(reach if several else 0):
        least = written(links.join(found, "id").groupBy("grp").agg(F.min("home").alias("home")), "least")
        after = written(links.join(least, "grp").groupBy("id").agg(F.min("home").alias("home")), "homes")
        for old in (found, least):
            dropped(old)
        found = after
    return found.select("id", "home")


def propagated(links: DataFrame, shards: int, capacity: float, rounds: int = 12, slack: float = 0.1, reach: int = 2) -> DataFrame:
    """(id, shard, home) for every id of ``links(id, grp)``, with few shards per group. A shard may hold ``slack`` more than
    the capacity while rows move, as the ranking evens it out; one that starts with more takes none in."""
    links = links.distinct()
    labels = written(homes(links, reach).withColumn("shard", F.pmod("home", F.lit(shards)).cast("int")).select("id", "shard", "home"), "labels")
    quiet = 0
    for step in range(rounds):
        load = np.zeros(shards)
        for s, n in labels.groupBy("shard").count().collect():
            load[s] = n
        limit = max(capacity * (1 + slack), capacity + 1)
        open_ = F.array(*[F.lit(bool(x < limit)) for x in load])
        votes = links.join(labels, "id").groupBy("grp").agg(*[F.sum((F.col("shard") == s).cast("long")).alias(f"v{s}") for s in range(shards)])
        votes = written(votes, "votes")
        heard = links.join(votes, "grp").groupBy("id").agg(F.count("*").alias("own"), *[F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)])
        state = labels.join(heard, "id").withColumn("v", F.array(*[f"v{s}" for s in range(shards)]))
        way = F.lit(1 if step % 2 == 0 else -1)
        # the best open shard in this round's direction: most votes, then the lowest number
        ranked = F.transform("v", lambda n, s: F.struct(F.when(F.element_at(open_, s + 1) & ((s - F.col("shard")) * way > 0), n).otherwise(F.lit(-1)).alias("n"), (-s).alias("s")))
        wish = state.select("id", "shard", "home", F.array_max(ranked).alias("best"), (F.element_at("v", F.col("shard") + 1) - F.col("own")).alias("here"))
        gain = F.col("best.n") - F.col("here")
        wish = wish.select("id", "shard", "home", (-F.col("best.s")).cast("int").alias("target"), F.when(gain > 0, F.least(F.floor(F.log2(gain.cast("double"))), F.lit(GAINS - 1)).cast("int")).alias("gain"))
        wish = written(wish, "wishes")
        asked = np.zeros((shards, shards, GAINS))
        for a, b, g, n in wish.where("gain is not null").groupBy("shard", "target", "gain").count().collect():
            asked[a, b, g] = n
        quiet = quiet + 1 if not asked.sum() else 0
        if not asked.sum():
            dropped(votes)
            dropped(wish)
            if quiet == 2:
                break
            continue
        share = granted(asked, load, limit)
        flat = F.array(*[F.lit(float(x)) for x in share.ravel()])  # shards x shards x GAINS numbers
        cell = (F.col("shard") * shards + F.col("target")) * GAINS + F.col("gain")
        draw = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(1 << 30)) / float(1 << 30)
        goes = F.coalesce((F.col("gain").isNotNull()) & (draw < F.element_at(flat, cell.cast("int") + 1)), F.lit(False))
        after = written(wish.select("id", F.when(goes, F.col("target")).otherwise(F.col("shard")).alias("shard"), "home"), "labels")
        for old in (labels, votes, wish):
            dropped(old)
        labels = after
    return labels


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their position in the order, from 0, counted per range partition and never in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=[*b.schema.names, "_part", "_at"])
            at += b.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done = written(spread.mapInArrow(number, f"{schema}, _part int, _at long"), "ranked")
    sizes = dict(done.groupBy("_part").count().collect())  # one row per partition
    start, bases = 0, {}
    for part in sorted(sizes):
        bases[part], start = start, start + sizes[part]
    base = F.element_at(F.array(*[F.lit(bases.get(p, 0)).cast("long") for p in range(parts)]), F.col("_part") + 1)
    return done.withColumn("position", base + F.col("_at")).drop("_part", "_at")


def shard_rows(rows: DataFrame, links: DataFrame, shards: int = 16, rounds: int = 12) -> DataFrame:
    """``rows`` (written, with a unique column id) with shard and slot; ``links`` are (id, grp)."""
    n = rows.count()
    capacity = n / shards
    labels = propagated(links, shards, capacity, rounds)
    load = np.zeros(shards)
    for s, k in labels.groupBy("shard").count().collect():
        load[s] = k
    left = np.maximum(capacity - load, 0)
    edges = np.cumsum(left) / max(left.sum(), 1e-9)
    draw = F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(1 << 30)) / float(1 << 30)
    free = F.least(sum([(draw >= float(e)).cast("int") for e in edges], F.lit(0)), F.lit(shards - 1))
    placed = rows.join(labels.withColumnRenamed("shard", "_shard"), "id", "left")
    # rows without links lie at both ends of a shard, where the cuts fall
    zone = F.when(F.col("_shard").isNotNull(), 1).otherwise(F.pmod(F.xxhash64("id", F.lit(-2)), F.lit(2)).cast("int") * 2)
    placed = placed.select(*rows.columns, F.coalesce("_shard", free).alias("_shard"), zone.alias("_zone"), "home")
    found = ranked(placed, ["_shard", "_zone", "home", "id"])
    shard = F.expr(f"position * {shards} div {max(n, 1)}").cast("int")
    return found.withColumn("shard", shard).withColumn("slot", F.col("position") - F.ceil(F.col("shard") * F.lit(n) / shards)).drop("_shard", "_zone", "home", "position")


def cut_groups(sharded: DataFrame) -> DataFrame:
    """(groups, cut_groups, cut_rows) over groups of two rows or more; cut rows are those outside their group's main shard."""
    per = sharded.groupBy("grp", "shard").count().groupBy("grp").agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.count("*").alias("parts")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.sum((F.col("parts") > 1).cast("long")).alias("cut_groups"), F.sum(F.col("n") - F.col("most")).alias("cut_rows"))


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, grp, id, shard, slot): equal texts are linked. ``id`` numbers the rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = own_names(docs, [id_col, text_col]).select(id_col, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("grp"), F.monotonically_increasing_id().alias("id"))
    rows = written(rows, "rows")
    # written, so that both sides of the joins on a group are plain shuffles, of which a hot group's part can be split
    several = written(rows.groupBy("grp").count().where("count > 1").select("grp"), "groups")
    links = written(rows.select("id", "grp").join(several, "grp", "left_semi").select("id", "grp"), "links")
    return shard_rows(rows, links, shards, rounds)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_documents(table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
