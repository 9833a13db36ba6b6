"""The relational queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, association, conformance, dfg, discovery, distance, filters, log, probability, sampling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def as_text() -> Column:
    """The trace as one string, which any engine compares alike."""
    return log.joined().alias("trace")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def session_events(spark: SparkSession, sf_dir: str, parity: int | None = None) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id")
    return log.sessions(rows if parity is None else rows.where(F.col("user_id") % 2 == parity), "user_id", "ts", ["event_id"])


def session_log(spark: SparkSession, sf_dir: str, parity: int | None = None) -> DataFrame:
    return log.to_log(session_events(spark, sf_dir, parity), "case_id", "event_type", ["ts", "event_id"])


def session_slang(spark: SparkSession, sf_dir: str, parity: int | None = None) -> DataFrame:
    return log.slang(session_log(spark, sf_dir, parity))


def two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return session_slang(spark, sf_dir, 0), session_slang(spark, sf_dir, 1)


LOG = """
e AS (SELECT user_id, event_type, ts, event_id,
        CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e),
log AS (SELECT user_id, user_id || '-' || session::BIGINT AS case_id, list(event_type ORDER BY ts, event_id) AS acts,
        string_agg(event_type, ',' ORDER BY ts, event_id) AS trace FROM s GROUP BY user_id, session),
slang AS (SELECT trace, any_value(acts) AS acts, count(*) AS cnt, (SELECT count(*) FROM log) AS n FROM log GROUP BY trace),
code AS (SELECT *, list_aggregate(list_transform(acts, lambda x: x[1]), 'string_agg', '') AS code FROM slang),
a AS (SELECT trace, any_value(acts) AS acts, count(*) AS cnt, (SELECT count(*) FROM log WHERE user_id % 2 = 0) AS n FROM log WHERE user_id % 2 = 0 GROUP BY trace),
b AS (SELECT trace, any_value(acts) AS acts, count(*) AS cnt, (SELECT count(*) FROM log WHERE user_id % 2 = 1) AS n FROM log WHERE user_id % 2 = 1 GROUP BY trace),
ab AS (SELECT a.trace, a.acts, a.cnt / a.n AS pa, coalesce(b.cnt / b.n, 0) AS pb FROM a LEFT JOIN b USING (trace)),
steps AS (SELECT user_id, unnest(list_concat([NULL], acts)) AS src, unnest(list_concat(acts, [NULL])) AS dst FROM log),
dfg AS (SELECT src, dst, count(*) AS weight FROM steps GROUP BY src, dst),
dfga AS (SELECT src, dst, count(*) AS weight FROM steps WHERE user_id % 2 = 0 GROUP BY src, dst),
dfgb AS (SELECT src, dst, count(*) AS weight FROM steps WHERE user_id % 2 = 1 GROUP BY src, dst)
"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; its SQL may use the log, languages and graphs defined in LOG."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = f"WITH {LOG} {sql}"
        return f

    return add


@query("SELECT trace, cnt, round(cnt / n, 6) AS p FROM slang")
def variants(spark, d):
    return session_slang(spark, d).select(as_text(), "cnt", F.round(log.p(), 6).alias("p"))


@query("SELECT case_id, trace FROM log")
def convert_log(spark, d):
    return session_log(spark, d).select("case_id", as_text())


@query("SELECT DISTINCT trace FROM log")
def convert_lang(spark, d):
    return log.lang(session_log(spark, d)).select(as_text())


@query("SELECT DISTINCT event_type AS activity FROM events")
def activities(spark, d):
    return log.activities(session_log(spark, d))


@query("SELECT trace, cnt, round(cnt / n, 6) AS p FROM slang")
def all_traces(spark, d):
    return session_slang(spark, d).select(as_text(), "cnt", F.round(log.p(), 6).alias("p"))


@query("SELECT count(*) > 0 AS any_traces FROM log")
def any_traces(spark, d):
    return session_log(spark, d).agg((F.count("*") > 0).alias("any_traces"))


@query("SELECT coalesce(bool_or(len(acts) = 0), false) AS empty_traces FROM log")
def empty_traces(spark, d):
    return session_log(spark, d).agg(F.coalesce(F.bool_or(F.size("trace") == 0), F.lit(False)).alias("empty_traces"))


for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "="), ("ne", "<>")):
    query(f"SELECT case_id, trace FROM log WHERE NOT (len(acts) {_op} 3)", f"filter_length_{_name}")(lambda s, d, op=_op: filters.remove_length(session_log(s, d), op, 3).select("case_id", as_text()))
query("SELECT case_id, trace FROM log WHERE len(acts) > 0", "filter_empty")(lambda s, d: filters.remove_empty(session_log(s, d)).select("case_id", as_text()))
for _name, _sql in (("any", "list_contains(acts, 'click')"), ("all", "len(list_filter(acts, lambda x: x <> 'click')) = 0"), ("none", "NOT list_contains(acts, 'click')"), ("start", "coalesce(acts[1] = 'click', false)"), ("end", "coalesce(acts[-1] = 'click', false)")):
    query(f"SELECT case_id, trace FROM log WHERE NOT ({_sql})", f"filter_activity_{_name}")(lambda s, d, k=_name: filters.remove_activity(session_log(s, d), k, "click").select("case_id", as_text()))


@query("SELECT case_id, trace FROM log WHERE NOT (trace || ',') LIKE '%click,error,%' AND acts[-1] <> 'signup'")
def filter_edges(spark, d):
    edges = spark.sql("SELECT * FROM VALUES ('click', 'error'), ('signup', CAST(NULL AS STRING)) AS t(src, dst)")
    return filters.remove_edges(session_log(spark, d), edges).select("case_id", as_text())


@query("SELECT src, dst, weight FROM dfg")
def dfg_full(spark, d):
    return dfg.dfg(session_log(spark, d))


@query("SELECT src, dst, weight FROM dfg")
def dfg_events(spark, d):
    return dfg.dfg_of_events(session_events(spark, d), "case_id", "event_type", ["ts", "event_id"])


@query("SELECT src, dst, round(sum(cnt / n), 6) AS weight FROM (SELECT cnt, n, unnest(list_concat([NULL], acts)) AS src, unnest(list_concat(acts, [NULL])) AS dst FROM slang) GROUP BY src, dst")
def dfg_of_language(spark, d):
    return dfg.dfg(session_slang(spark, d).withColumn("p", log.p()), "p").withColumn("weight", F.round("weight", 6))


@query("SELECT coalesce(sum(abs(coalesce(x.weight, 0) - coalesce(y.weight, 0))), 0)::BIGINT AS difference FROM dfga x FULL JOIN dfgb y ON x.src IS NOT DISTINCT FROM y.src AND x.dst IS NOT DISTINCT FROM y.dst")
def dfg_edge_difference(spark, d):
    return dfg.edge_difference(dfg.dfg(session_log(spark, d, 0)), dfg.dfg(session_log(spark, d, 1)))


@query("SELECT count(*) FILTER (WHERE (x.weight IS NULL) <> (y.weight IS NULL)) AS difference FROM dfga x FULL JOIN dfgb y ON x.src IS NOT DISTINCT FROM y.src AND x.dst IS NOT DISTINCT FROM y.dst")
def dfg_edge_difference_no_frequency(spark, d):
    return dfg.edge_difference_no_frequency(dfg.dfg(session_log(spark, d, 0)), dfg.dfg(session_log(spark, d, 1)))


@query("SELECT round(s / (s + CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END), 6) AS completeness FROM (SELECT count(*) AS s, count(*) FILTER (WHERE cnt = 1) AS f1, count(*) FILTER (WHERE cnt = 2) AS f2 FROM slang)")
def completeness(spark, d):
    return analysis.completeness(session_log(spark, d)).select(F.round("completeness", 6).alias("completeness"))


@query("SELECT trace, cnt FROM slang WHERE cnt / n >= 0.01")
def minimum_probability(spark, d):
    return analysis.minimum_probability(session_slang(spark, d), 0.01).select(as_text(), "cnt")


@query("SELECT trace, cnt FROM slang ORDER BY cnt DESC, trace LIMIT 10")
def most_likely_traces(spark, d):
    return analysis.most_likely(session_slang(spark, d), 10).select(as_text(), "cnt")


@query("SELECT trace, cnt FROM slang ORDER BY cnt DESC, trace LIMIT 1")
def mode(spark, d):
    return analysis.mode(session_slang(spark, d)).select(as_text(), "cnt")


@query("SELECT trace, cnt FROM (SELECT trace, cnt, n, coalesce(sum(cnt) OVER (ORDER BY cnt DESC, substr(md5(trace), 1, 3), trace ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM slang) WHERE before < 0.8 * n")
def coverage(spark, d):
    return analysis.coverage(session_slang(spark, d), 0.8).select(as_text(), "cnt")


@query("SELECT round(sum(-(cnt / n) * log2(cnt / n)), 6) AS entropy FROM slang")
def entropy(spark, d):
    return analysis.entropy(session_slang(spark, d)).select(F.round("entropy", 6).alias("entropy"))


@query("SELECT round(sum(levenshtein(x.code, y.code) * (x.cnt / x.n) * (y.cnt / y.n)), 6) AS variety FROM code x JOIN code y ON x.code < y.code")
def variety(spark, d):
    return analysis.variety(session_slang(spark, d)).select(F.round("variety", 6).alias("variety"))


_SUMS = "SELECT x.trace, sum(levenshtein(x.code, y.code) / greatest(length(x.code), length(y.code)) * {w}) AS d FROM code x, code y GROUP BY x.trace"


@query(f"SELECT trace, round(d, 6) AS distance FROM ({_SUMS.format(w='y.cnt / y.n')})")
def distance_sums(spark, d):
    return analysis.distance_sums(session_slang(spark, d)).select(as_text(), F.round("distance", 6).alias("distance"))


@query(f"SELECT trace FROM ({_SUMS.format(w='y.cnt / y.n')}) ORDER BY round(d, 9), trace LIMIT 3")
def medoid(spark, d):
    return analysis.medoid(session_slang(spark, d), 3).select(as_text())


@query(f"SELECT trace FROM ({_SUMS.format(w='1')}) ORDER BY round(d, 9), trace LIMIT 3")
def medoid_non_stochastic(spark, d):
    return analysis.medoid(session_slang(spark, d), 3, weighted=False).select(as_text())


@query("SELECT x.trace AS a, y.trace AS b, levenshtein(x.code, y.code) AS distance, round(levenshtein(x.code, y.code) / greatest(length(x.code), length(y.code)), 6) AS normalised FROM code x JOIN code y ON x.code < y.code")
def distance_matrix(spark, d):
    (coded,) = distance.encoded(session_slang(spark, d))
    coded = coded.withColumn("trace", log.joined())
    return distance.pairs(coded).select(F.least("a_trace", "b_trace").alias("a"), F.greatest("a_trace", "b_trace").alias("b"), F.levenshtein("a_code", "b_code").cast("long").alias("distance"), F.round(distance.normalised("a_code", "b_code"), 6).alias("normalised"))


@query("SELECT coalesce(bool_and(ts >= last OR last IS NULL), true) AS ordered FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events)")
def timestamps_ordered(spark, d):
    return analysis.timestamps_ordered(events(spark, d), "user_id", "ts", ["event_id"])


@query("SELECT round(1 - sum(greatest(0, pa - pb)), 6) AS value FROM ab")
def conformance_uemsc(spark, d):
    return conformance.unit_earth_movers(conformance.probed(*two(spark, d))).select(F.round("value", 6).alias("value"))


@query("SELECT round(1 - sqrt(sum(pow(sqrt(pb) - sqrt(pa), 2)) / 2), 6) AS value FROM ab")
def conformance_hellinger(spark, d):
    return conformance.hellinger(conformance.probed(*two(spark, d))).select(F.round("value", 6).alias("value"))


@query("SELECT round(1 - sum(pow(pa - pb, 2) / (pa + pb)) / 2, 6) AS value FROM ab")
def conformance_chi_squared(spark, d):
    return conformance.chi_squared(conformance.probed(*two(spark, d))).select(F.round("value", 6).alias("value"))


@query("SELECT round(1 - sqrt((sum(pa * log2(pa) + pb * log2(pb) - (pa + pb) * log2(pa + pb) + pa + pb) + 1 - sum(pa) + 1 - sum(pb)) / 2), 6) AS value FROM ab WHERE pb > 0")
def conformance_jensen_shannon(spark, d):
    return conformance.jensen_shannon(conformance.probed(*two(spark, d))).select(F.round("value", 6).alias("value"))


@query("""SELECT round(j - rho * log2(rho) - CASE WHEN rho < 1 THEN (1 - rho) * log2(1 - rho) ELSE 0 END, 6) AS value FROM (
  SELECT sum(pa * CASE WHEN pb > 0 THEN -log2(pb) ELSE (len(acts) + 1) * log2(1 + (SELECT count(DISTINCT x) FROM (SELECT unnest(acts) AS x FROM a))) END) AS j,
         sum(pa) FILTER (WHERE pb > 0) AS rho FROM ab)""")
def conformance_entropic_relevance(spark, d):
    return conformance.entropic_relevance(*two(spark, d)).select(F.round("value", 6).alias("value"))


@query("SELECT round(sum(CASE WHEN pb > 0 THEN least(-pa * log2(pa), -pb * log2(pb)) END) / sum(-pa * log2(pa)), 6) AS value FROM ab")
def conformance_gain_recall(spark, d):
    return conformance.gain_recall(conformance.probed(*two(spark, d))).select(F.round("value", 6).alias("value"))


def _grams(table: str, k: int) -> str:
    return f"""SELECT trace, sum(cnt) AS cnt FROM (SELECT cnt, unnest(CASE WHEN len(t) <= {k} THEN [t] ELSE list_transform(range(1, len(t) - {k} + 2), lambda i: t[i:i + {k} - 1]) END) AS trace
  FROM (SELECT list_concat(['+'], acts, ['-']) AS t, cnt FROM {table})) GROUP BY trace"""


@query(f"SELECT list_aggregate(trace, 'string_agg', ',') AS trace, cnt::BIGINT AS cnt FROM ({_grams('slang', 2)})")
def markovian_kgrams(spark, d):
    return conformance.kgrams(session_slang(spark, d), 2).select(as_text(), "cnt")


_MARKOV = {"uemsc": "1 - sum(greatest(0, pa - pb))", "hsc": "1 - sqrt(sum(pow(sqrt(pb) - sqrt(pa), 2)) / 2)", "cssc": "1 - sum(pow(pa - pb, 2) / (pa + pb)) / 2"}
for _name, _sql in _MARKOV.items():
    _both = f"(SELECT x.cnt / (SELECT sum(cnt) FROM ({_grams('a', 3)})) AS pa, coalesce(y.cnt / (SELECT sum(cnt) FROM ({_grams('b', 3)})), 0) AS pb FROM ({_grams('a', 3)}) x LEFT JOIN ({_grams('b', 3)}) y USING (trace))"
    query(f"SELECT round({_sql}, 6) AS value FROM {_both}", f"markovian_{_name}")(lambda s, d, k=_name: conformance.markovian(*two(s, d), 3, k).select(F.round("value", 6).alias("value")))


@query("SELECT round(sum(b.cnt) / max(b.n), 6) AS probability FROM b WHERE trace IN (SELECT trace FROM a)")
def probability_log(spark, d):
    a, b = two(spark, d)
    return probability.of_log(b, a).select(F.round("probability", 6).alias("probability"))


@query("SELECT round(coalesce(max(cnt / n), 0), 6) AS probability FROM slang WHERE trace = 'view,click'")
def probability_trace(spark, d):
    return probability.of_trace(session_slang(spark, d), ["view", "click"]).select(F.round("probability", 6).alias("probability"))


_PREFIX = "(SELECT list_aggregate(acts[:i], 'string_agg', ',') AS prefix, CASE WHEN i < len(acts) THEN acts[i + 1] END AS next, cnt FROM (SELECT acts, cnt, unnest(range(0, len(acts) + 1)) AS i FROM slang))"


@query(f"SELECT coalesce(prefix, '') AS prefix, bool_or(next IS NULL) AS final FROM {_PREFIX} GROUP BY prefix")
def prefix_tree(spark, d):
    return discovery.prefix_tree(log.lang(session_log(spark, d))).select(log.joined("prefix").alias("prefix"), "final")


@query(f"SELECT coalesce(prefix, '') AS prefix, next, sum(cnt)::BIGINT AS cnt, round(sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY prefix), 6) AS probability FROM {_PREFIX} GROUP BY prefix, next")
def convert_sdfa(spark, d):
    return discovery.prefix_sdfa(session_slang(spark, d)).select(log.joined("prefix").alias("prefix"), "next", "cnt", F.round("probability", 6).alias("probability"))


@query("SELECT 0 AS src, activity, 0 AS dst FROM (SELECT DISTINCT event_type AS activity FROM events)")
def flower_dfa(spark, d):
    return discovery.flower_dfa(session_log(spark, d))


@query("SELECT DISTINCT trace FROM slang")
def trace_model(spark, d):
    return discovery.trace_model(session_log(spark, d)).select(as_text())


@query("SELECT activity, round(sum(cnt) / max(n), 6) AS weight FROM (SELECT unnest(acts) AS activity, cnt, n FROM slang) GROUP BY activity")
def occurrence_weights(spark, d):
    return discovery.occurrence_weights(session_slang(spark, d)).withColumn("weight", F.round("weight", 6))


@query("SELECT src AS activity, weight FROM dfg WHERE src = dst")
def self_loops(spark, d):
    return discovery.self_loops(dfg.dfg(session_log(spark, d)))


_THREE = "SELECT a, b, count(*) AS weight FROM (SELECT acts[i] AS a, acts[i + 1] AS b, acts[i + 2] AS c FROM (SELECT acts, unnest(range(1, len(acts) - 1)) AS i FROM log)) WHERE a = c AND a <> b GROUP BY a, b"


@query(_THREE)
def short_loops(spark, d):
    return discovery.short_loops(session_log(spark, d))


@query(f"SELECT x.src AS a, x.dst AS b FROM dfg x JOIN dfg y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst AND abs(x.weight - y.weight) <= 0.1 * (x.weight + y.weight) AND NOT EXISTS (SELECT 1 FROM ({_THREE}) t WHERE (t.a = x.src AND t.b = x.dst) OR (t.a = x.dst AND t.b = x.src))")
def concurrent_pairs(spark, d):
    own = session_log(spark, d)
    return discovery.concurrent_pairs(dfg.dfg(own), discovery.short_loops(own), 0.1)


_USERS = "(SELECT list_aggregate(list_transform(acts, lambda x: x[1]), 'string_agg', '') AS code, v FROM (SELECT list(event_type ORDER BY ts, event_id) AS acts, sum(value) AS v FROM events GROUP BY user_id))"


@query(f"SELECT round(corr(abs(s.v - t.v), levenshtein(s.code, t.code) / greatest(length(s.code), length(t.code))), 4) AS association FROM {_USERS} s, {_USERS} t")
def association_numeric(spark, d):
    rows = events(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    worth = rows.groupBy("user_id").agg(F.sum("value").alias("worth"))
    own = log.to_log(rows, "user_id", "event_type", ["ts", "event_id"])
    own = own.join(worth, own.case_id == worth.user_id).select("case_id", "trace", "worth")
    return association.numeric(own, "worth").select(F.round("association", 4).alias("association"))


@query("SELECT user_id AS case_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS trace FROM events GROUP BY user_id HAVING ((user_id * 48271 + 11) % 2147483647) % 5 = 2")
def sample_folds(spark, d):
    own = log.to_log(events(spark, d).select("user_id", "event_type", "ts", "event_id"), "user_id", "event_type", ["ts", "event_id"])
    return sampling.folds_arithmetic(own, 5, 2, "case_id").select("case_id", as_text())


def sampled(table: str, k: int, b: int) -> str:
    """SQL of a sample of k traces by arithmetic draws from b on: (trace, cnt, n)."""
    return f"""(SELECT trace, count(*) AS cnt, {k} AS n FROM (SELECT trace, cnt, sum(cnt) OVER (ORDER BY cnt, substr(md5(trace), 1, 3), trace ROWS UNBOUNDED PRECEDING) AS upto FROM {table}) v
  JOIN (SELECT floor((i * 1103515245 + {b}) % 2147483647 / 2147483647.0::DOUBLE * (SELECT sum(cnt) FROM {table})) AS place FROM (SELECT unnest(range({k})) AS i)) u ON place >= upto - cnt AND place < upto GROUP BY trace)"""


@query(f"SELECT trace, cnt FROM {sampled('slang', 500, 11)}")
def sample_traces(spark, d):
    return sampling.sample_traces(session_slang(spark, d), 500, draws=sampling.arithmetic_draws(spark, 500)).select(as_text(), "cnt")
