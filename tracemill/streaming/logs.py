"""Structured Streaming: logs that grow. The definitions are this engine's own.

``sessions`` closes cases by event time; ``follows`` keeps each case's last activity and the events that the watermark
hasn't passed as state and gives a directly-follows graph's new steps; ``graph_sink`` adds them up in a table. Late events beyond the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, user: str, activity: str, ts: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(case_id, begin, end, trace) of each session that is over: built-in session windows with a watermark."""
    own = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w"))
    rows = own.agg(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(activity).alias("a")))).alias("e"))
    return rows.select(F.concat_ws("@", F.col(user).cast("string"), F.col("w.start").cast("string")).alias("case_id"), F.col("w.start").alias("begin"), F.col("w.end").alias("end"), F.col("e.a").alias("trace"))


def follows(events: DataFrame, case: str, activity: str, ts: str, late: str = "1 hour", idle: str = "6 hours", position: str | None = None) -> DataFrame:
    """(src, dst, weight): steps that can no longer change. A case that is idle past the watermark ends: a null dst.

    Events wait in state until the watermark has passed them, so one that comes late but in time still gets its place;
    equal times go by ``position``, a whole number, then by activity. State is one activity and time per open case, and
    the events that wait.
    """
    idle_us = int(pd.Timedelta(idle).total_seconds() * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at, text = state.get if state.exists else (None, 0, "[]")
        waiting = [tuple(x) for x in json.loads(text)]
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["t"].astype("datetime64[us]").astype("int64").tolist(), rows["i"].tolist(), rows["a"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        over = [x for x in waiting if x[0] < mark]
        waiting = waiting[len(over) :]
        names = [a for _, _, a in over]
        sources, targets = [last, *names[:-1]][: len(names)], list(names)
        last, at = (names[-1], over[-1][0]) if over else (last, at)
        if not waiting and last is not None and at + idle_us < mark:
            sources, targets = [*sources, last], [*targets, None]
            state.remove()
        else:
            state.update((last, at, json.dumps(waiting)))
            due = waiting[0][0] if waiting else at + idle_us
            state.setTimeoutTimestamp(max(due, mark) // 1000 + 1)
        yield pd.DataFrame({"src": sources, "dst": targets, "weight": 1})

    own = events.withWatermark(ts, late).select(F.col(case).cast("string").alias("c"), F.col(activity).alias("a"), F.col(ts).alias("t"), (F.col(position) if position else F.lit(0)).cast("long").alias("i"))
    return own.groupBy("c").applyInPandasWithState(step, "src string, dst string, weight long", "last string, at long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def graph_sink(path: str):
    """For foreachBatch: the steps of each batch, summed, as a part of a table that :func:`graph` adds up. A batch that is
    repeated after a failure replaces its part."""

    def write(steps: DataFrame, batch: int) -> None:
        steps.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def graph(parts: DataFrame) -> DataFrame:
    return parts.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
