"""Discovery that is an aggregation: weights, tries, flower and trace models. Model objects are in tracemill.models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import activities, prefixes


def occurrence_weights(slang: DataFrame) -> DataFrame:
    """(activity, weight): expected occurrences per trace."""
    return slang.select(F.explode("trace").alias("activity"), "cnt", "n").groupBy("activity").agg((F.sum("cnt") / F.max("n")).alias("weight"))


def with_weights(transitions: DataFrame, weights: DataFrame) -> DataFrame:
    """``transitions(transition, label)`` with weights: silent ones get 1, labels that never occur 0."""
    return transitions.join(weights, transitions.label == weights.activity, "left").select("transition", "label", F.when(F.col("label").isNull(), 1.0).otherwise(F.coalesce("weight", F.lit(0.0))).alias("weight"))


def uniform_weights(transitions: DataFrame) -> DataFrame:
    return transitions.withColumn("weight", F.lit(1.0))


def random_weights(transitions: DataFrame, seed: int | None = None) -> DataFrame:
    """Weights over 0 and up to 1, of ten digits."""
    return transitions.withColumn("weight", F.round(1 - F.rand(seed) * (1 - 1e-10), 10))


def alignment_weights(moves: DataFrame, transitions: DataFrame) -> DataFrame:
    """``moves(p, kind, transition)``: summed probability of the moves that fire a transition."""
    fired = moves.where("kind != 'log'").groupBy("transition").agg(F.sum("p").alias("weight"))
    return transitions.join(fired, "transition", "left").select("transition", "label", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def flower_dfa(language: DataFrame) -> DataFrame:
    """One final state with a loop per activity."""
    return activities(language).select(F.lit(0).alias("src"), "activity", F.lit(0).alias("dst"))


def prefix_tree(language: DataFrame) -> DataFrame:
    """(prefix, final): the states of the trie of all traces, final where a trace ends."""
    return prefixes(language).groupBy("prefix").agg(F.bool_or(F.col("next").isNull()).alias("final"))


def prefix_sdfa(slang: DataFrame) -> DataFrame:
    """(prefix, next, cnt, probability): the stochastic prefix automaton; a null next is termination.

    The total of a state is the count of its own prefix, joined, so no window has to hold a state's edges in order.
    """
    edges = prefixes(slang, "cnt").groupBy("prefix", "next").agg(F.sum("cnt").alias("cnt"))
    states = edges.groupBy("prefix").agg(F.sum("cnt").alias("_all"))
    return edges.join(states, "prefix").select("prefix", "next", "cnt", (F.col("cnt") / F.col("_all")).alias("probability"))


def trace_model(language: DataFrame) -> DataFrame:
    """The branches of the choice over all traces."""
    return language.select("trace").distinct()


def self_loops(graph: DataFrame) -> DataFrame:
    return graph.where("src = dst").select(F.col("src").alias("activity"), "weight")


def short_loops(log: DataFrame) -> DataFrame:
    """(a, b, weight): how often a b a occurs, for different a and b."""
    at = F.explode(F.sequence(F.lit(0), F.size("trace") - 3))
    three = log.where("size(trace) >= 3").select(at.alias("i"), "trace").select(*[F.get("trace", F.col("i") + k).alias(c) for k, c in enumerate("abc")])
    return three.where("a = c and a != b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def concurrent_pairs(graph: DataFrame, loops: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """(a, b): activities that follow each other about equally often both ways and form no short loop."""
    own = graph.where("src is not null and dst is not null and src != dst")
    ab = own.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("ab"))
    ba = own.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("weight").alias("ba"))
    even = ab.join(ba, ["a", "b"]).where(F.abs(F.col("ab") - F.col("ba")) <= epsilon * (F.col("ab") + F.col("ba")))
    looped = loops.select("a", "b").union(loops.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return even.join(looped, ["a", "b"], "left_anti").where("a < b").select("a", "b")


