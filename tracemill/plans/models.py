"""The queries on models and kernels over the driver's tables; SQL wherever the result has a closed form."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import discovery as D
from ..models import markov
from ..models.objects import automaton_of_language, graph_of_language, net_of_automaton
from ..models.tree import net_of
from ..operators import alignment, association, conformance, dfg, log, sampling, statistics
from ..sources.formats import from_slang
from .catalogue import as_text, query, sampled, session_events, session_log, session_slang, two

SUBSET = ("click", "purchase", "view")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def flower(*names: str):
    return net_of_automaton(D.flower_automaton(names))


def language(spark: SparkSession, d: str, parity: int | None = None):
    return from_slang(session_slang(spark, d, parity))


def told(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_FITS = "len(list_filter(acts, lambda x: x IN ('click', 'purchase', 'view')))"


@query(f"SELECT trace, {_FITS}::BIGINT AS synchronous, (len(acts) - {_FITS})::BIGINT AS moves_on_log FROM slang")
def alignments(spark, d):
    found = alignment.align(session_slang(spark, d), flower(*SUBSET))
    count = lambda k: F.size(F.filter("moves", lambda m: m["kind"] == k)).cast("long")
    return found.select(as_text(), count("synchronous").alias("synchronous"), count("log").alias("moves_on_log"))


@query(f"SELECT trace, len(acts) - {_FITS} = 0 AS fits FROM slang")
def set_alignments(spark, d):
    found = alignment.align(log.lang(session_log(spark, d)), flower(*SUBSET))
    return found.select(as_text(), (~F.exists("moves", lambda m: m["kind"].isin("log", "model"))).alias("fits"))


@query(f"SELECT round(sum(cnt / n * CASE WHEN len(acts) = 0 THEN 1 ELSE {_FITS} / len(acts) END), 6) AS fitness FROM slang")
def trace_fitness(spark, d):
    return rounded(alignment.trace_fitness(alignment.align(session_slang(spark, d), flower(*SUBSET))), "fitness")


@query(f"SELECT round(sum(CASE WHEN {_FITS} = len(acts) THEN cnt ELSE 0 END) / sum(cnt), 6) AS fitting FROM slang")
def fitting_traces(spark, d):
    return rounded(alignment.fitting_traces(alignment.align(session_slang(spark, d), flower(*SUBSET))), "fitting")


_STEPS = "SELECT prefix, next, sum(cnt) AS cnt FROM (SELECT list_aggregate(acts[:i], 'string_agg', ',') AS prefix, CASE WHEN i < len(acts) THEN acts[i + 1] ELSE '$' END AS next, cnt FROM (SELECT acts, cnt, unnest(range(0, len(acts) + 1)) AS i FROM slang)) GROUP BY prefix, next"


@query(f"SELECT round(sum(cnt * taken) / sum(cnt * 6), 6) AS precision FROM (SELECT prefix, sum(cnt) AS cnt, count(*) AS taken FROM ({_STEPS}) GROUP BY prefix)")
def escaping_edges_precision(spark, d):
    model = flower("click", "error", "purchase", "signup", "view")
    return rounded(alignment.escaping_edges_precision(alignment.align(session_slang(spark, d), model), model), "precision")


@query("SELECT a.trace, round(coalesce(b.cnt / b.n, 0), 6) AS probability FROM a LEFT JOIN b USING (trace)")
def probability_of_model(spark, d):
    found = alignment.probabilities(session_slang(spark, d, 0), automaton_of_language(language(spark, d, 1)))
    return found.select(as_text(), F.round("pb", 6).alias("probability"))


@query("SELECT round(1 - sum(greatest(0, pa - pb)), 6) AS value FROM ab")
def conformance_uemsc_model(spark, d):
    return rounded(conformance.unit_earth_movers(alignment.probed(session_slang(spark, d, 0), automaton_of_language(language(spark, d, 1)))), "value")


@query("SELECT round(j - rho * log2(rho) - (1 - rho) * log2(1 - rho), 6) AS value FROM (SELECT sum(pa * CASE WHEN pb > 0 THEN -log2(pb) ELSE (len(acts) + 1) * log2(1 + (SELECT count(DISTINCT x) FROM (SELECT unnest(acts) AS x FROM a))) END) AS j, sum(pa) FILTER (WHERE pb > 0) AS rho FROM ab)")
def conformance_entropic_relevance_model(spark, d):
    a = session_slang(spark, d, 0)
    return rounded(conformance.relevance_of(alignment.probed(a, automaton_of_language(language(spark, d, 1))), a), "value")


@query("SELECT round(sum(CASE WHEN pb > 0 THEN least(-pa * log2(pa), -pb * log2(pb)) END) / (SELECT sum(-cnt / n * log2(cnt / n)) FROM b), 6) AS value FROM ab")
def conformance_gain_precision(spark, d):
    model = automaton_of_language(language(spark, d, 1))
    return rounded(conformance.gain_precision(alignment.probed(session_slang(spark, d, 0), model), markov.entropy(model)), "value")


@query("SELECT round(sum(-(cnt / n) * log2(cnt / n)), 6) AS entropy FROM slang")
def entropy_of_model(spark, d):
    return told(spark, [(round(markov.entropy(automaton_of_language(language(spark, d))), 6),)], "entropy double")


def _traces(spark, found):
    return told(spark, [(",".join(t), round(float(p), 6)) for p, t in found], "trace string, p double")


@query("SELECT trace, round(cnt / n, 6) AS p FROM slang WHERE cnt / n >= 0.01")
def minimum_probability_of_model(spark, d):
    return _traces(spark, markov.minimum_probability(automaton_of_language(language(spark, d)), Fraction(1, 100)))


@query("SELECT round(cnt / n, 6) AS p FROM slang ORDER BY cnt DESC LIMIT 10")
def most_likely_traces_of_model(spark, d):
    return _traces(spark, markov.most_likely(automaton_of_language(language(spark, d)), 10)).select("p")


@query("SELECT round(cnt / n, 6) AS p FROM (SELECT cnt, n, coalesce(sum(cnt) OVER (ORDER BY cnt DESC, trace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM slang) WHERE before < 0.5 * n")
def coverage_of_model(spark, d):
    return _traces(spark, markov.coverage(automaton_of_language(language(spark, d)), Fraction(1, 2))).select("p")


@query("""SELECT list_aggregate(trace, 'string_agg', ',') AS trace, round(sum(cnt) / sum(sum(cnt)) OVER (), 6) AS p FROM (
  SELECT cnt, unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1])) AS trace FROM (SELECT list_concat(['+'], acts, ['-']) AS t, cnt FROM slang)) GROUP BY trace""")
def markovian_abstraction_of_model(spark, d):
    return _traces(spark, [(p, g) for g, p in markov.abstraction(automaton_of_language(language(spark, d)), 2).items()])


@query(None)
def conformance_markovian_model(spark, d):
    net = D.occurrence(net_of(D.inductive(language(spark, d), Fraction(1, 5))), occurrences(spark, d))
    model = told(spark, [(list(g), float(p), 1.0) for g, p in markov.abstraction(net, 2).items()], "trace array<string>, cnt double, n double")
    return rounded(conformance.unit_earth_movers(conformance.probed(conformance.kgrams(session_slang(spark, d), 2), model)), "value")


def occurrences(spark, d) -> dict[str, Fraction]:
    rows = session_slang(spark, d).select(F.explode("trace").alias("a"), "cnt", "n").groupBy("a").agg(F.sum("cnt").alias("c"), F.max("n").alias("n")).collect()  # one row per activity
    return {r.a: Fraction(r.c, r.n) for r in rows}


@query(None)
def conformance_emsc(spark, d):
    return rounded(statistics.earth_movers(*two(spark, d)), "value")


def samples(spark, d, k: int) -> list[DataFrame]:
    return [sampling.sample_traces(x, k, draws=sampling.arithmetic_draws(spark, k, b)) for x, b in zip(two(spark, d), (11, 12), strict=True)]


@query(None)
def conformance_emsc_sample(spark, d):
    return rounded(statistics.earth_movers(*samples(spark, d, 100)), "value")


_DRAWN = f"(SELECT x.cnt / x.n AS pa, coalesce(y.cnt / y.n, 0) AS pb FROM {sampled('a', 1000, 11)} x LEFT JOIN {sampled('b', 1000, 12)} y USING (trace))"
SAMPLED = {
    "uemsc": (conformance.unit_earth_movers, f"SELECT round(1 - sum(greatest(0, pa - pb)), 6) AS value FROM {_DRAWN}"),
    "hellinger": (conformance.hellinger, f"SELECT round(1 - sqrt(sum(pow(sqrt(pb) - sqrt(pa), 2)) / 2), 6) AS value FROM {_DRAWN}"),
    "chi_squared": (conformance.chi_squared, f"SELECT round(1 - sum(pow(pa - pb, 2) / (pa + pb)) / 2, 6) AS value FROM {_DRAWN}"),
    "jensen_shannon": (conformance.jensen_shannon, f"SELECT round(1 - sqrt((sum(pa * log2(pa) + pb * log2(pb) - (pa + pb) * log2(pa + pb) + pa + pb) + 1 - sum(pa) + 1 - sum(pb)) / 2), 6) AS value FROM {_DRAWN} WHERE pb > 0"),
}
for _name, (_measure, _sql) in SAMPLED.items():
    query(_sql, f"conformance_{_name}_sample")(lambda s, d, f=_measure: rounded(f(conformance.probed(*samples(s, d, 1000))), "value"))


@query(None)
def bootstrap_test(spark, d):
    return rounded(statistics.bootstrap_test(*two(spark, d)), "base", "p")


@query(None)
def permutation_test(spark, d):
    return rounded(statistics.permutation_test(*two(spark, d)), "base", "p")


@query(None)
def permutation_test_model(spark, d):
    part = session_slang(spark, d, 0)
    return rounded(statistics.permutation_test_model(part, automaton_of_language(from_slang(part))), "p")


@query(None)
def categorical_attribute_test(spark, d):
    own = session_events(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"), F.min("ts").alias("t"))
    own = own.select("case_id", F.col("e.event_type").alias("trace"), F.hour("t").alias("hour")).withColumn("half", F.when(F.col("hour") < 12, "am").otherwise("pm"))
    return rounded(statistics.categorical_test(own, "half"), "p")


@query(None)
def association_categorical(spark, d):
    own = session_events(spark, d).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"), F.min("ts").alias("t"))
    own = own.select("case_id", F.col("e.event_type").alias("trace"), F.when(F.hour("t") < 12, "am").otherwise("pm").alias("half"))
    return association.categorical(own, "half")


@query(None)
def cluster(spark, d):
    return statistics.cluster(session_slang(spark, d), 3).select(as_text())


@query(None)
def sample_model(spark, d):
    return statistics.sample_model(spark, automaton_of_language(language(spark, d)), 500).select(as_text(), "cnt")


@query(None)
def explain_trace(spark, d):
    own = session_slang(spark, d)
    found = alignment.explain(own, automaton_of_language(from_slang(own)))
    return found.select(as_text(), F.size("moves").alias("moves"))


def _case_events(spark, d):
    rows = session_events(spark, d)
    return rows.select("case_id", F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("activity"), "ts", F.concat(F.lit("r"), F.col("event_id") % 7).alias("resource"))


@query("SELECT case_id, (i - 1)::BIGINT AS move_index, acts[i] AS activity FROM (SELECT case_id, acts, unnest(range(1, len(acts) + 1)) AS i FROM log) UNION ALL SELECT case_id, len(acts)::BIGINT, NULL FROM log")
def executions(spark, d):
    model = flower("click", "error", "purchase", "signup", "view")
    return alignment.executions(_case_events(spark, d), model).select("case_id", F.col("move_index").cast("long").alias("move_index"), "activity")


_USED = """(SELECT *, greatest(enabled_at, used_at) AS start FROM (SELECT case_id, activity, r, time,
    lag(time) OVER (PARTITION BY case_id, activity ORDER BY time, event_id) AS enabled_at, lag(time) OVER (PARTITION BY r ORDER BY time, case_id, event_id) AS used_at, event_id
  FROM (SELECT user_id || '-' || session::BIGINT AS case_id, event_type AS activity, event_id % 7 AS r, ts AS time, event_id FROM s)))"""


@query(f"""SELECT activity, count(*) AS known, round(avg(share), 6) AS utilisation FROM (
  SELECT x.event_id, x.activity, CASE WHEN any_value(x.start) IS NULL THEN 0 ELSE count(DISTINCT y.r) / any_value(k.able) END AS share
  FROM {_USED} x JOIN (SELECT activity, count(DISTINCT r) AS able FROM {_USED} GROUP BY 1) k USING (activity)
  LEFT JOIN (SELECT DISTINCT activity AS can, r AS who FROM {_USED}) c ON c.can = x.activity
  LEFT JOIN {_USED} y ON y.r = c.who AND (y.start IS NULL OR y.start < x.start) AND y.time > x.start GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT NULL, 0, NULL""")
def executions_utilisation(spark, d):
    model = flower("click", "error", "purchase", "signup", "view")
    found = alignment.with_utilisation(alignment.executions(_case_events(spark, d), model))
    return found.groupBy("activity").agg(F.count("resource_utilisation").alias("known"), F.round(F.avg("resource_utilisation"), 6).alias("utilisation"))


@query("SELECT coalesce(bool_and(ts >= latest), true) AS ordered FROM (SELECT ts, max(ts) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS latest FROM s)")
def executions_ordered(spark, d):
    model = flower("click", "error", "purchase", "signup", "view")
    return alignment.executions_ordered(alignment.executions(_case_events(spark, d), model))


@query(None)
def inductive_miner(spark, d):
    return told(spark, [(str(D.inductive(language(spark, d))),)], "tree string")


@query(None)
def inductive_miner_infrequent(spark, d):
    return told(spark, [(str(D.inductive(language(spark, d), Fraction(1, 5))),)], "tree string")


@query(None)
def split_miner(spark, d):
    found = D.split_miner(language(spark, d))
    return told(spark, [(a, b) for _, a, b, _ in found.flows], "source string, target string")


@query("SELECT coalesce(acts[1], '') AS first, count(*) AS branches FROM slang GROUP BY 1")
def prefix_process_tree(spark, d):
    traces = set(language(spark, d))
    tree = D.prefix_tree(traces)
    branch = lambda c: c.children[0].label if c.children else c.label or ""
    return told(spark, [(branch(c), sum(t[:1] == (branch(c),) for t in traces)) for c in tree.children], "first string, branches long")


@query("SELECT count(*) AS branches, sum(len(acts))::BIGINT AS leaves FROM slang")
def trace_model_tree(spark, d):
    tree = D.trace_tree(set(language(spark, d)))
    return told(spark, [(len(tree.children), len(tree.leaves()))], "branches long, leaves long")


@query("SELECT activity, round(sum(cnt) / max(n), 6) AS weight FROM (SELECT unnest(acts) AS activity, cnt, n FROM slang) GROUP BY activity")
def occurrence_net(spark, d):
    net = D.occurrence(flower("click", "error", "purchase", "signup", "view"), occurrences(spark, d))
    return told(spark, [(t.label, round(float(t.weight), 6)) for t in net.transitions if t.label], "activity string, weight double")


@query("SELECT activity, round(sum(cnt) / max(n), 6) AS weight FROM (SELECT unnest(acts) AS activity, cnt, n FROM slang) GROUP BY activity UNION ALL SELECT NULL, 1.0")
def alignment_net(spark, d):
    model = flower("click", "error", "purchase", "signup", "view")
    label = {i: t.label for i, t in enumerate(model.transitions)}
    names = spark.createDataFrame(list(label.items()), "transition int, activity string")
    return alignment.weights(alignment.align(session_slang(spark, d), model)).join(F.broadcast(names), "transition").select("activity", F.round("weight", 6).alias("weight"))


@query("SELECT activity, 1.0 AS weight FROM (SELECT DISTINCT event_type AS activity FROM events)")
def uniform_net(spark, d):
    net = D.uniform(flower(*sorted(occurrences(spark, d))))
    return told(spark, [(t.label, float(t.weight)) for t in net.transitions if t.label], "activity string, weight double")


@query("SELECT src, dst, weight::BIGINT AS weight FROM dfg")
def convert_sdfm(spark, d):
    return dfg.dfg(session_slang(spark, d), "cnt")


@query(None)
def dfg_with_fitness(spark, d):
    return dfg.dfg_with_fitness(session_log(spark, d), 0.8)
