"""Runs a command on files: ``python -m tracemill conformance unit-earth-movers a.slang b.xes``."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from .models import convert
from .models.objects import FollowsGraph, as_model, as_net
from .operators import log
from .plans.commands import COMMANDS, documentation
from .sources import formats, logs


def loaded(spark: SparkSession, kind: str, given: str):
    if kind in ("text", "number", "fraction"):
        return Fraction(given) if kind == "fraction" else given
    if given.endswith((".xes", ".xes.gz", ".csv", ".parquet")):
        events = spark.read.parquet(given) if given.endswith(".parquet") else logs.read_csv(spark, given) if given.endswith(".csv") else logs.read_xes(spark, given)
        own = logs.log_of(events)
        found = {"events": lambda: events, "log": lambda: own, "slang": lambda: log.slang(own), "lang": lambda: log.lang(own)}
        return found[kind]() if kind in found else prepared(spark, kind, formats.from_slang(log.slang(own)))
    return prepared(spark, kind, formats.read(given))


def prepared(spark: SparkSession, kind: str, thing):
    if kind in ("slang", "lang", "log"):
        rows = formats.to_slang(spark, convert.language(thing))
        return rows if kind == "slang" else rows.select("trace") if kind == "lang" else rows.selectExpr("explode(sequence(1, cnt)) AS i", "trace").selectExpr("uuid() AS case_id", "trace")
    if kind == "alignments":
        total = sum((a.weight for a in thing), Fraction(0))
        rows = [([{"kind": k, "label": x, "transition": t} for k, x, t in a.moves], float(a.weight), float(total)) for a in thing]
        return spark.createDataFrame(rows, "moves array<struct<kind: string, label: string, transition: int>>, cnt double, n double")
    if kind == "graph":
        return thing if isinstance(thing, FollowsGraph) else convert.follows(thing)
    return {"model": as_model, "net": as_net, "diagram": convert.diagram}.get(kind, lambda x: x)(thing)


def said(result: DataFrame) -> Iterator[str]:
    """All rows, as they come from one partition after the other."""
    return (str(r.asDict(recursive=True)) for r in result.toLocalIterator())


def shown(result: object, wanted: str = "") -> str:
    """As text; objects in the wanted format, else in the first that holds them."""
    if isinstance(result, DataFrame):
        return "\n".join(said(result))
    if isinstance(result, dict) and all(isinstance(k, str) for k in result):  # what info counts
        return "\n".join(f"{k}: {v}" for k, v in result.items())
    for f in sorted(formats.FORMATS.values(), key=lambda f: f.name != wanted):
        if f.write and not isinstance(result, (str, list, bool, int, float, Fraction)):
            try:
                return f.write(result)
            except (AttributeError, TypeError, ValueError, KeyError):
                continue
    return str(result)


def main(args: list[str]) -> int:
    name = next((" ".join(args[:n]) for n in range(min(4, len(args)), 0, -1) if " ".join(args[:n]) in COMMANDS), None)
    if name is None:
        print(documentation())
        return 1
    command, given = COMMANDS[name], args[len(name.split()) :]
    if len(given) != len(command.takes):
        print(f"{name} takes {' '.join(command.takes)}")
        return 1
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = command.run(*[loaded(spark, k, g) for k, g in zip(command.takes, given, strict=True)])
    for row in said(result) if isinstance(result, DataFrame) else [shown(result, name.split()[-1])]:
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
