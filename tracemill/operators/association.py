"""Association between a trace attribute and the order of activities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import AT_ONCE, between, encoded, in_cells
from .distance import cells as pairs

#: Kinds of cases, of one variant and value, whose counts go to the driver, and bytes of draws that are broadcast at once.
MOST_KINDS, DRAWS_BYTES = 1_000_000, 128 << 20


def numeric(log: DataFrame, attribute: str) -> DataFrame:
    """Correlation of the attribute's difference with the traces' distance over all ordered pairs of cases."""
    return numerics(log, [attribute]).select("association")


def numerics(log: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, association) as of :func:`numeric`, of all attributes by one pass over the pairs, which are measured once.

    Cases of the same variant and values are one row with a count; each pair weighs as often as it occurs, and pairs of a
    row with itself have no difference and no distance. A case counts for the attributes that it has.
    """
    values = [f"v{k}" for k in range(len(attributes))]
    rows = log.groupBy("trace", *[F.col(a).cast("double").alias(v) for a, v in zip(attributes, values, strict=True)]).agg(F.count("*").alias("cnt"))
    (coded,) = encoded(rows.where(F.coalesce(*values).isNotNull()))
    key = F.concat_ws("\n", "code", *[F.coalesce(F.format_string("%.17g", v), F.lit("-")) for v in values])
    coded = coded.withColumn("symbols", F.col("code")).withColumn("code", key).select("code", "symbols", *values, "cnt")
    names = [f"{v}_{k}" for v in values for k in ("sx", "sy", "sxx", "syy", "sxy")]

    def of_cell(left: dict[str, np.ndarray], right: dict[str, np.ndarray], times: int) -> dict[str, list]:
        cost, found = between(left["symbols"], right["symbols"]), dict.fromkeys(names, 0.0)
        step = max(1, AT_ONCE // max(1, len(right["cnt"])))
        for at in range(0, len(left["cnt"]), step):
            y = cost.rows(at, at + step)
            for v in values:
                own, other = left[v][at : at + step], right[v]
                n, m = (np.where(np.isnan(x), 0, c) for x, c in ((own, left["cnt"][at : at + step]), (other, right["cnt"])))
                x = np.abs(np.nan_to_num(own)[:, None] - np.nan_to_num(other))
                for k, z in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y)):
                    found[f"{v}_{k}"] += times * float(n @ (z @ m))
        return {k: [x] for k, x in found.items()}

    met = in_cells(of_cell, pairs(coded), ", ".join(f"{k} double" for k in names))
    sums = met.agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in names])
    total = coded.agg(*[F.pow(F.sum(F.when(F.col(v).isNotNull(), F.col("cnt"))).cast("double"), 2).alias(f"{v}_n") for v in values])

    def association(v: str) -> Column:
        n, sx, sy, sxx, syy, sxy = (F.col(f"{v}_{k}") for k in ("n", "sx", "sy", "sxx", "syy", "sxy"))
        low = F.sqrt(n * sxx - F.pow(sx, 2)) * F.sqrt(n * syy - F.pow(sy, 2))
        return F.when(low > 0, (n * sxy - sx * sy) / low)

    each = F.array(*[F.struct(F.lit(a).alias("attribute"), association(v).alias("association")) for a, v in zip(attributes, values, strict=True)])
    return sums.join(F.broadcast(total)).select(F.explode(each).alias("x")).select("x.*")


NUMERIC = ("double", "long", "integer", "float", "short", "byte", "decimal", "timestamp", "timestamp_ntz", "date")
CATEGORICAL = ("string", "boolean")


def as_number(log: DataFrame, attribute: str) -> DataFrame:
    """The attribute as a double: a time as its microseconds."""
    kind = log.schema[attribute].dataType.typeName()
    return log.withColumn(attribute, F.unix_micros(F.col(attribute).cast("timestamp")).cast("double")) if kind in ("timestamp", "timestamp_ntz", "date") else log


def all_attributes(log: DataFrame, without: tuple[str, ...] = ("case_id", "trace")) -> DataFrame:
    """(attribute, association) of every attribute: numbers and times by :func:`numeric`, texts and booleans by
    :func:`categorical`; others have none."""
    kinds = {f.name: f.dataType.typeName() for f in log.schema if f.name not in without}
    numbers, out = [a for a, k in kinds.items() if k in NUMERIC], log.sparkSession.createDataFrame([], "attribute string, association double")
    if numbers:
        timed = log
        for a in numbers:
            timed = as_number(timed, a)
        out = numerics(timed, numbers)
    for a in (a for a, k in kinds.items() if k in CATEGORICAL):
        out = out.unionByName(categorical(log, a).select(F.lit(a).alias("attribute"), "association"))
    return out


def resampled(log: DataFrame, attribute: str, samples: int, size: int | None, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sample of cases drawn with replacement: (how often each value is drawn, summed distance of all ordered pairs of
    draws, and of those with equal values).

    Cases of one variant and value are a kind; the kinds' counts go to the driver, which draws how often each is drawn.
    Distances are computed once per pair of kinds, in cells of two blocks, whose matrix is multiplied by the draws of all
    samples; these are broadcast, ``DRAWS_BYTES`` at most, and more samples take further passes.
    """
    rows = log.where(F.col(attribute).isNotNull()).groupBy("trace", F.col(attribute).cast("string").alias("value")).agg(F.count("*").alias("cnt"))
    (coded,) = encoded(rows)
    kinds = coded.select("code", "value", "cnt").orderBy("code", "value").limit(MOST_KINDS + 1).toPandas()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of cases")
    values, value = np.unique(kinds["value"].to_numpy(dtype=str), return_inverse=True)
    n, rng, spark = size or int(kinds["cnt"].sum()), np.random.default_rng(seed), log.sparkSession
    if not len(kinds):
        return np.zeros((samples, 0)), np.zeros(samples), np.zeros(samples)
    numbered = kinds.assign(i=range(len(kinds)), code=kinds["code"] + "\n" + kinds["value"], symbols=kinds["code"], v=value)
    table = spark.createDataFrame(numbered[["code", "symbols", "i", "v"]], "code string, symbols string, i int, v int")
    dealt, parts, step = pairs(table), [], max(1, DRAWS_BYTES // (4 * len(kinds)))
    for first in range(0, samples, step):
        drawn = rng.multinomial(n, kinds["cnt"] / kinds["cnt"].sum(), size=min(step, samples - first))
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(drawn.T.astype(np.int32 if n < 1 << 31 else np.int64)))

        def of_cell(left: dict[str, np.ndarray], right: dict[str, np.ndarray], times: int, shared=shared) -> dict[str, list]:
            cost, w, m = between(left["symbols"], right["symbols"]), shared.value[left["i"]].astype(float), shared.value[right["i"]].astype(float)
            total, same = np.zeros((2, m.shape[1])), [(v, np.flatnonzero(right["v"] == v)) for v in np.intersect1d(left["v"], right["v"])]
            rows = max(1, AT_ONCE // max(1, len(m)))
            for at in range(0, len(w), rows):
                d, own = cost.rows(at, at + rows), w[at : at + rows]
                total[0] += (own * (d @ m)).sum(axis=0)
                for v, j in same:
                    i = np.flatnonzero(left["v"][at : at + rows] == v)
                    if len(i):
                        total[1] += (own[i] * (d[np.ix_(i, j)] @ m[j])).sum(axis=0)
            return {"k": np.arange(m.shape[1]), "every": times * total[0], "equal": times * total[1]}

        sums = in_cells(of_cell, dealt, "k long, every double, equal double").groupBy("k").agg(F.sum("every").alias("every"), F.sum("equal").alias("equal")).toPandas()  # one row per sample
        found = np.zeros((2, drawn.shape[0]))
        found[:, sums["k"].to_numpy(dtype=int)] = sums[["every", "equal"]].to_numpy().T
        parts.append((np.stack([drawn[:, value == v].sum(axis=1) for v in range(len(values))], axis=1).astype(float), *found))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def categorical(log: DataFrame, attribute: str, samples: int = 500, size: int | None = None, seed: int = 0) -> DataFrame:
    """1 - correlation, over samples drawn with replacement, of the mean distance of pairs with different values with that
    of all pairs; null where one of them never varies."""
    masses, every, equal = resampled(log, attribute, samples, size, seed)
    all_pairs = masses.sum(axis=1) ** 2
    differing = all_pairs - (masses**2).sum(axis=1)
    use = differing > 0
    x, y = (every - equal)[use] / differing[use], every[use] / all_pairs[use]
    value = float(1 - np.corrcoef(x, y)[0, 1]) if use.sum() > 1 and x.std() > 0 and y.std() > 0 else None
    return log.sparkSession.createDataFrame([(value,)], "association double")
