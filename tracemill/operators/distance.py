"""Edit distances between variants, in blocks that spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models.edits import Normalised
from .log import activities

#: Symbols that an activity is encoded as, from here on.
FIRST_SYMBOL = 0x21
MOST_ACTIVITIES = 50_000
#: Rows of a block of a pairwise join, and the fewest blocks.
BLOCK_ROWS, LEAST_BLOCKS = 2_000, 16
#: The same of cells that are worked on as a whole, and cells of distances that are numbers at once there.
CELL_ROWS, LEAST_CELLS, AT_ONCE = 4_096, 6, 250_000


def encoded(language: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """The languages with ``code``: a string with one code point per event, from one dictionary over all of them.

    The dictionary goes to the driver: one row per activity, ``MOST_ACTIVITIES`` at most.
    """
    every = activities(language)
    for o in others:
        every = every.union(activities(o)).distinct()
    names = sorted(r[0] for r in every.limit(MOST_ACTIVITIES + 1).collect())
    if len(names) > MOST_ACTIVITIES:
        raise ValueError(f"more than {MOST_ACTIVITIES} activities")
    symbol = F.create_map(*[F.lit(x) for i, a in enumerate(names) for x in (a, chr(FIRST_SYMBOL + i if FIRST_SYMBOL + i < 0xD800 else FIRST_SYMBOL + i + 0x800))]) if names else None
    code = F.concat_ws("", F.transform("trace", lambda a: F.element_at(symbol, a))) if names else F.lit("")
    return [df.withColumn("code", code) for df in (language, *others)]


def normalised(a: str | Column, b: str | Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def pairs(language: DataFrame, blocks: int | None = None) -> DataFrame:
    """Each unordered pair of rows (with ``code``) once, as a_* and b_* columns: rows are dealt to blocks by hash, and each
    pair of blocks is one key of an ordinary join, so that work spreads over ``blocks * (blocks + 1) / 2`` keys. Without a
    number there are as many blocks as give each about ``BLOCK_ROWS`` rows."""
    return grid(language, language, blocks, same=True)


def grid(left: DataFrame, right: DataFrame, blocks: int | None = None, same: bool = False) -> DataFrame:
    """Every row of one side with every row of the other, or each unordered pair of one, joined on pairs of blocks."""
    blocks = blocks or max(LEAST_BLOCKS, -(-left.count() // BLOCK_ROWS))
    own = F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = left.withColumn("_own", own).withColumn("_other", every).select(*[F.col(c).alias(f"a_{c}") for c in left.columns], F.struct(F.col("_own").alias("x"), F.col("_other").alias("y")).alias("_cell"))
    b = right.withColumn("_own", own).withColumn("_other", every).select(*[F.col(c).alias(f"b_{c}") for c in right.columns], F.struct(F.col("_other").alias("x"), F.col("_own").alias("y")).alias("_cell"))
    # a fixed number of partitions: cells are few bytes and much work, and must not be gathered into few tasks
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.sparkSession.sparkContext.defaultParallelism)
    if same:
        a, b = a.where("_cell.x <= _cell.y"), b.where("_cell.x <= _cell.y")
        return a.repartition(parts, "_cell").join(b.repartition(parts, "_cell"), "_cell").where((F.col("_cell.x") < F.col("_cell.y")) | (F.col("a_code") < F.col("b_code"))).drop("_cell")
    return a.repartition(parts, "_cell").join(b.repartition(parts, "_cell"), "_cell").drop("_cell")


def cells(language: DataFrame) -> DataFrame:
    """The rows (with ``code``) as often as there are blocks, with x, y and own: cell x, y has the rows of blocks x and y, x
    at most y, and own is the row's block. A cell is one group of much work, so partitions are as many as cells."""
    blocks = max(LEAST_CELLS, -(-language.count() // CELL_ROWS))
    own, other = F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = language.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    return dealt.repartition(min(blocks * (blocks + 1) // 2, 10_000), "x", "y")


def in_cells(of_cell: Callable[[dict[str, np.ndarray], dict[str, np.ndarray], int], dict[str, list]], rows: DataFrame, schema: str) -> DataFrame:
    """What ``of_cell`` makes of each cell's two blocks, as columns: its third argument is how often a pair of them counts,
    where every two rows count twice, once each way."""

    def work(cell: pa.Table) -> pa.Table:
        columns = {k: cell[k].to_numpy() for k in cell.column_names}
        x, y = columns["x"][0], columns["y"][0]
        side = lambda k: {n: c[columns["own"] == k] for n, c in columns.items()}
        return pa.table(of_cell(side(x), side(y), 1 if x == y else 2))

    return rows.groupBy("x", "y").applyInArrow(work, schema)


def between(left: np.ndarray, right: np.ndarray) -> Normalised:
    """The normalised distances of two lists of codes, of which equal ones are measured once."""
    (a, i), (b, j) = (np.unique(c.astype(str), return_inverse=True) for c in (left, right))
    return Normalised.of(a.tolist(), b.tolist()).part(i, j)
