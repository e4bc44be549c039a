"""Reports and the cache, with SQL twins. The moment of the reports is fixed, never the clock's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import SPACE
from lexlode.operators import reporting as R
from lexlode.plans.retrieval import Q_SQL, queries
from lexlode.session import shared_dir
from lexlode.sources.tables import table

CFG = Settings()
NOW, DAYS, RECENT = 1706659200.0, 14, 50


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delivered_once(table(spark, sf_dir, "query_logs"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delivered_once(table(spark, sf_dir, "eval_metrics"))


def eval_summary(spark, sf_dir):
    return R.summary(logs(spark, sf_dir), metrics(spark, sf_dir))


def grade_dist(spark, sf_dir):
    return R.grade_counts(logs(spark, sf_dir))


def strategy_dist(spark, sf_dir):
    return R.strategy_counts(logs(spark, sf_dir))


def percent_mix(spark, sf_dir):
    a = R.grade_mix(logs(spark, sf_dir)).select(F.lit("grade").alias("kind"), F.col("crag_grade").alias("value"), "percent")
    return a.unionByName(R.strategy_mix(logs(spark, sf_dir)).select(F.lit("strategies").alias("kind"), F.col("strategies").alias("value"), "percent"))


def recent_queries(spark, sf_dir):
    return R.recent(logs(spark, sf_dir), metrics(spark, sf_dir), RECENT).select("id", "timestamp", "query", F.array_join("strategy_list", ",").alias("strategies"), "crag_grade", *R.METRICS)


def metric_timeseries(spark, sf_dir):
    t = R.timeseries(logs(spark, sf_dir), metrics(spark, sf_dir), NOW, DAYS)
    return t.select("hour_bucket", "n", *(F.round(f"avg_{m}", 9).alias(f"avg_{m}") for m in R.METRICS[:4]))


def unevaluated_logs(spark, sf_dir):
    return R.unevaluated(logs(spark, sf_dir), metrics(spark, sf_dir)).select("id")


def cache_replay(spark, sf_dir):
    return R.cache_replay(logs(spark, sf_dir)).withColumn("age", F.round("age", 6))


def cache_stats(spark, sf_dir):
    return R.cache_totals(R.cache_replay(logs(spark, sf_dir)))


def cache_lookup(spark, sf_dir):
    rows = logs(spark, sf_dir)
    got = R.cache_lookup(queries(spark, sf_dir), R.cache_table(rows.where(F.col("timestamp") <= NOW - 86400 * 2)), NOW - 86400 * 2)
    return got.select("query_id", "key", F.col("payload").isNotNull().alias("hit"))


def cache_flush(spark, sf_dir):
    """Keys left after the entries of the batch's queries are dropped."""
    keys = queries(spark, sf_dir).select(R.cache_key("query", CFG.final_top_k).alias("key"))
    return R.cache_without(R.cache_table(logs(spark, sf_dir)), keys).select("key", "written_at")


def cached_answers(spark, sf_dir):
    """A batch at one moment: stored answers, live ones for the rest, and a second batch that finds them stored."""
    now, base = NOW - 86400 * 2, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"
    R.store_cache(R.cache_table(logs(spark, sf_dir).where(F.col("timestamp") <= now)), base)
    live = lambda missed: missed.select("query_id", F.to_json(F.struct(F.length("query").alias("n"))).alias("payload"))
    first, fresh = R.cached_answers(queries(spark, sf_dir), R.stored_cache(spark, base), now, live)
    R.store_cache(fresh, base)
    again, _ = R.cached_answers(queries(spark, sf_dir), R.stored_cache(spark, base), now + 1, live)
    return first.join(again.select("query_id", F.col("hit").alias("hit_again"), F.col("payload").alias("payload_again")), "query_id").select(
        "query_id", "key", "hit", "hit_again", (F.col("payload") == F.col("payload_again")).alias("same"))


def metrics_bundle(spark, sf_dir):
    """The sections of the whole report: number of rows, and one value of the summary and of the cache."""
    b = R.metrics_bundle(logs(spark, sf_dir), metrics(spark, sf_dir), NOW, DAYS, RECENT)
    value = F.when(F.col("section") == "summary", F.get_json_object("payload", "$.total_queries")).when(F.col("section") == "cache", F.get_json_object("payload", "$.hits"))
    return b.groupBy("section").agg(F.count("*").alias("n"), F.max(value.cast("long")).alias("value"))


QUERIES = {f.__name__: f for f in (eval_summary, grade_dist, strategy_dist, percent_mix, recent_queries, metric_timeseries, unevaluated_logs, cache_replay, cache_stats, cache_lookup, cache_flush, cached_answers, metrics_bundle)}

_L = "l AS (SELECT DISTINCT ON (id) * FROM query_logs), m AS (SELECT DISTINCT ON (id) * FROM eval_metrics)"
_KEY = f"substr(sha256(lower(regexp_replace(query, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) || ':{CFG.final_top_k}'), 1, 24)"
_AVG = ", ".join(f"round_even(coalesce(avg({m}), 0), 3) AS avg_{m}" for m in R.METRICS[:4])
_REPLAY = f"""WITH {_L}, k AS (SELECT id, timestamp, {_KEY} AS key, CASE WHEN num_chunks > 0 THEN timestamp END AS written FROM l),
p AS (SELECT id, key, timestamp, max(written) OVER (PARTITION BY key ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
r AS (SELECT id, key, coalesce(timestamp - before < {CFG.cache_ttl_seconds}, false) AS hit, CASE WHEN timestamp - before < {CFG.cache_ttl_seconds} THEN timestamp - before END AS age FROM p)"""
ORACLE = {
    "eval_summary": f"""WITH {_L} SELECT * FROM (SELECT count(*) AS total_queries, round_even(coalesce(avg(CASE WHEN latency_ms > 0 THEN latency_ms END), 0), 1) AS avg_latency_ms FROM l),
        (SELECT count(*) AS evaluated_queries, {_AVG} FROM m)""",
    "grade_dist": f"WITH {_L} SELECT crag_grade, count(*) AS n FROM l WHERE crag_grade <> '' GROUP BY 1",
    "strategy_dist": f"WITH {_L} SELECT strategies, count(*) AS n FROM l GROUP BY 1",
    "percent_mix": f"""WITH {_L}, g AS (SELECT crag_grade, count(*) AS n FROM l WHERE crag_grade <> '' GROUP BY 1), s AS (SELECT strategies, count(*) AS n FROM l GROUP BY 1)
        SELECT 'grade' AS kind, v.value, CAST(round(coalesce(n, 0) / (SELECT greatest(sum(n), 1) FROM g) * 100) AS BIGINT) AS percent FROM (VALUES ('GOOD'), ('POOR'), ('ABSENT')) v(value) LEFT JOIN g ON crag_grade = value
        UNION ALL SELECT 'strategies', strategies, CAST(round(n / (SELECT greatest(sum(n), 1) FROM s) * 100) AS BIGINT) FROM s""",
    "recent_queries": f"""WITH {_L} SELECT l.id, l.timestamp, query, array_to_string(CAST(from_json(strategies, '["VARCHAR"]') AS VARCHAR[]), ',') AS strategies, crag_grade, {', '.join(R.METRICS)}
        FROM l LEFT JOIN m ON m.query_log_id = l.id ORDER BY l.timestamp DESC, l.id DESC, m.id NULLS FIRST LIMIT {RECENT}""",
    "metric_timeseries": f"""WITH {_L} SELECT CAST(floor((l.timestamp - {NOW - DAYS * 86400}) / 3600) AS BIGINT) AS hour_bucket, count(*) AS n, {', '.join(f'round(avg({m}), 9) AS avg_{m}' for m in R.METRICS[:4])}
        FROM l JOIN m ON m.query_log_id = l.id WHERE l.timestamp > {NOW - DAYS * 86400} GROUP BY 1""",
    "unevaluated_logs": f"WITH {_L} SELECT id FROM l WHERE id NOT IN (SELECT query_log_id FROM m)",
    "cache_replay": _REPLAY + " SELECT id, key, hit, round(age, 6) AS age FROM r",
    "cache_stats": _REPLAY + f" SELECT CAST(sum(hit::INT) AS BIGINT) AS hits, CAST(sum((NOT hit)::INT) AS BIGINT) AS misses, round_even(sum(hit::INT)::DOUBLE / count(*), 3) AS hit_rate, CAST({CFG.cache_ttl_seconds} AS BIGINT) AS ttl_seconds FROM r",
    "cache_lookup": f"""WITH {_L}, {Q_SQL}, c AS (SELECT {_KEY} AS key, max(timestamp) AS w FROM l WHERE num_chunks > 0 AND timestamp <= {NOW - 172800} GROUP BY 1)
        SELECT query_id, {_KEY} AS key, EXISTS (SELECT 1 FROM c WHERE c.key = {_KEY} AND {NOW - 172800} - w < {CFG.cache_ttl_seconds}) AS hit FROM q""",
    "cache_flush": f"WITH {_L}, {Q_SQL} SELECT {_KEY} AS key, max(timestamp) AS written_at FROM l WHERE num_chunks > 0 AND {_KEY} NOT IN (SELECT {_KEY} FROM q) GROUP BY 1",
    "cached_answers": f"""WITH {_L}, {Q_SQL}, c AS (SELECT {_KEY} AS key, max(timestamp) AS w FROM l WHERE num_chunks > 0 AND timestamp <= {NOW - 172800} GROUP BY 1)
        SELECT query_id, {_KEY} AS key, EXISTS (SELECT 1 FROM c WHERE c.key = {_KEY} AND {NOW - 172800} - w < {CFG.cache_ttl_seconds}) AS hit, true AS hit_again, true AS same FROM q""",
    "metrics_bundle": _REPLAY + f""", t AS (SELECT DISTINCT CAST(floor((l.timestamp - {NOW - DAYS * 86400}) / 3600) AS BIGINT) AS h FROM l JOIN m ON m.query_log_id = l.id WHERE l.timestamp > {NOW - DAYS * 86400})
        SELECT 'summary' AS section, 1 AS n, (SELECT count(*) FROM l) AS value UNION ALL SELECT 'grades', 3, NULL UNION ALL SELECT 'strategies', (SELECT count(DISTINCT strategies) FROM l), NULL
        UNION ALL SELECT 'timeseries', (SELECT count(*) FROM t), NULL UNION ALL SELECT 'recent', (SELECT least({RECENT}, count(*)) FROM l), NULL UNION ALL SELECT 'cache', 1, (SELECT CAST(sum(hit::INT) AS BIGINT) FROM r)""",
}
