"""Reports over the query log and its quality metrics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import short_hash, strip
from lexlode.schemas import CACHE, GRADES, struct
from lexlode.session import cut
from lexlode.sources.store import read_table

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_utilisation", "mean_chunk_score")


def delivered_once(rows: DataFrame) -> DataFrame:
    """Rows that were delivered again dropped by their id."""
    return rows.dropDuplicates(["id"])


def summary(logs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: numbers of queries and evaluations, mean metrics (0 without any) and mean positive latency."""
    a = logs.agg(F.count("*").alias("total_queries"), F.bround(F.coalesce(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), F.lit(0.0)), 1).alias("avg_latency_ms"))
    b = metrics.agg(F.count("*").alias("evaluated_queries"), *(F.bround(F.coalesce(F.avg(m), F.lit(0.0)), 3).alias(f"avg_{m}") for m in METRICS[:4]))
    return a.join(F.broadcast(b))


def grade_counts(logs: DataFrame) -> DataFrame:
    """Queries per grade; empty and null grades are left out."""
    return logs.where("crag_grade <> ''").groupBy("crag_grade").agg(F.count("*").alias("n"))


def strategy_counts(logs: DataFrame) -> DataFrame:
    """Queries per list of retrievers as it was written, so that the order of names counts."""
    return logs.groupBy("strategies").agg(F.count("*").alias("n"))


def grade_mix(logs: DataFrame) -> DataFrame:
    """Percentage of each known grade, missing ones as 0."""
    known = logs.sparkSession.createDataFrame([(g,) for g in GRADES], "crag_grade string")
    total = grade_counts(logs).agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total"))
    return known.join(grade_counts(logs), "crag_grade", "left").join(F.broadcast(total)).select("crag_grade", F.round(F.coalesce("n", F.lit(0)) / F.col("total") * 100).cast("long").alias("percent"))


def strategy_mix(logs: DataFrame) -> DataFrame:
    counts = strategy_counts(logs)
    total = counts.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("strategies", F.round(F.col("n") / F.col("total") * 100).cast("long").alias("percent"))


def recent(logs: DataFrame, metrics: DataFrame, n: int) -> DataFrame:
    """The latest ``n`` log rows with their metrics; a log evaluated twice shows twice, one without metrics once.

    The latest logs are chosen before the join, so only they meet the metrics.
    """
    last = logs.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
    m = metrics.select(F.col("id").alias("metric_id"), F.col("query_log_id").alias("id"), *METRICS)
    joined = last.join(m, "id", "left").orderBy(F.col("timestamp").desc(), F.col("id").desc(), "metric_id").limit(n)
    return joined.withColumn("strategy_list", F.from_json("strategies", "array<string>"))


def timeseries(logs: DataFrame, metrics: DataFrame, now: float, days: int) -> DataFrame:
    """Mean metrics per hour since ``now`` - days; hours count from there, not from the clock's."""
    since = now - days * 86400
    inner = logs.where(F.col("timestamp") > since).select(F.col("id").alias("query_log_id"), "timestamp").join(metrics.drop("timestamp", "id"), "query_log_id")
    hour = F.floor((F.col("timestamp") - since) / 3600)
    return inner.groupBy(hour.alias("hour_bucket")).agg(F.count("*").alias("n"), *(F.avg(m).alias(f"avg_{m}") for m in METRICS[:4]))


def unevaluated(logs: DataFrame, metrics: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Log rows without metrics: the work list of the evaluation job, empty if evaluation is off."""
    if not cfg.eval_enabled:
        return logs.limit(0)
    return logs.join(metrics.select(F.col("query_log_id").alias("id")), "id", "left_anti")


def log_rows(answered: DataFrame, now: float, model: str, streamed: bool = False, cfg: Settings = Settings()) -> DataFrame:
    """Log rows of a batch of answered queries; streamed ones are logged only if the settings say so.

    ``answered``: query, intent, strategies (array), retriever_hits (map), crag_grade,
    rewritten_query, web_search_used, num_chunks, top_chunk_score, latency_ms. The id is given on appending.
    """
    rows = answered.select(
        F.lit(None).cast("long").alias("id"), F.lit(float(now)).alias("timestamp"), "query", "intent", F.to_json("strategies").alias("strategies"), F.to_json("retriever_hits").alias("retriever_hits"),
        "crag_grade", F.col("rewritten_query").isNotNull().cast("int").alias("crag_rewritten"), F.coalesce("web_search_used", F.lit(False)).cast("int").alias("web_search_used"),
        F.col("num_chunks").cast("int").alias("num_chunks"), "top_chunk_score", "latency_ms", F.lit(model).alias("model"), F.lit(cfg.graph_extractor).alias("extractor"))
    return rows.limit(0) if streamed and not cfg.log_streamed else rows


# ---- cache ------------------------------------------------------------------

def cache_key(query, final_k: int, candidate_k: int | None = None):
    """Key of a query: white space at the ends and case do not count; the number of candidates only if given."""
    parts = [F.lower(strip(query)), F.lit(str(final_k))] + ([F.lit(str(candidate_k))] if candidate_k is not None else [])
    return short_hash(*parts, size=24)


def _key(cfg: Settings):
    return cache_key("query", cfg.final_top_k, cfg.retrieval_top_k if cfg.cache_key_has_candidates else None)


def cache_replay(logs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Whether each logged query would be answered from the cache: id, key, hit, age.

    A query hits if one with its key and a result that is not empty came within the
    time to live before it. Rows meet within spans of that length, so a key that
    holds a third of the log is spread over its spans.
    """
    ttl = cfg.cache_ttl_seconds
    rows = logs.select("id", "timestamp", _key(cfg).alias("key"), F.when(F.col("num_chunks") > 0, F.col("timestamp")).alias("written"))
    rows = rows.withColumn("span", F.floor(F.col("timestamp") / ttl))
    earlier = Window.partitionBy("key", "span").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("before", F.max("written").over(earlier))
    last = rows.groupBy("key", (F.col("span") + 1).alias("span")).agg(F.max("written").alias("before_span"))
    age = F.col("timestamp") - F.coalesce("before", "before_span")
    joined = inside.join(last, ["key", "span"], "left").withColumn("age", age)
    hit = F.coalesce(F.col("age") < ttl, F.lit(False))
    return joined.select("id", "key", hit.alias("hit"), F.when(hit, F.col("age")).alias("age"))


def cache_totals(replay: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    hits = F.sum(F.col("hit").cast("long"))
    return replay.agg(F.coalesce(hits, F.lit(0)).alias("hits"), (F.count("*") - F.coalesce(hits, F.lit(0))).alias("misses"),
                      F.bround(F.coalesce(hits / F.count("*"), F.lit(0.0)), 3).alias("hit_rate"), F.lit(cfg.cache_ttl_seconds).cast("long").alias("ttl_seconds"))


def cache_table(logs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Latest non-empty result per key: key, payload, written_at."""
    rows = logs.where("num_chunks > 0").select(
        _key(cfg).alias("key"), F.col("timestamp").alias("written_at"), "id",
        F.to_json(F.struct("strategies", "retriever_hits", "num_chunks")).alias("payload"))
    return rows.groupBy("key").agg(F.max_by("payload", F.struct("written_at", "id")).alias("payload"), F.max("written_at").alias("written_at"))


def cache_lookup(queries: DataFrame, cache: DataFrame, now: float, cfg: Settings = Settings()) -> DataFrame:
    """query_id, key, payload (null for a miss) of a batch of queries at one moment."""
    live = cache.where((F.lit(now) - F.col("written_at") < cfg.cache_ttl_seconds) & (F.col("written_at") <= now)).select("key", "payload")
    asked = queries.select("query_id", _key(cfg).alias("key"))
    return asked.join(live, "key", "left").select("query_id", "key", "payload")


def cache_without(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The cache without some keys, or emptied."""
    return cache.limit(0) if keys is None else cache.join(keys.select("key").distinct(), "key", "left_anti")


def cached_answers(queries: DataFrame, cache: DataFrame, now: float, live, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Answer a batch from the cache, and what is not in it live: (answers, rows to store).

    ``live`` takes the queries that missed (query_id, query) and gives query_id, payload; each
    key is asked once, however many queries share it. Answers: query_id, key, hit, payload.
    Empty payloads are answers but are not stored.
    """
    asked = queries.select("query_id", "query", _key(cfg).alias("key"))
    known = cache.where((F.lit(now) - F.col("written_at") < cfg.cache_ttl_seconds) & (F.col("written_at") <= now)).select("key", F.col("payload").alias("stored"))
    found = cut(asked.join(known, "key", "left"), "cache-found")
    missed = found.where("stored is null").groupBy("key").agg(F.min_by(F.struct("query_id", "query"), "query_id").alias("q")).select("key", "q.query_id", "q.query")
    made = cut(live(missed.select("query_id", "query")).join(missed.select("query_id", "key"), "query_id").select("key", F.col("payload").alias("made")), "cache-made")
    answers = found.join(made, "key", "left").select("query_id", "key", F.col("stored").isNotNull().alias("hit"), F.coalesce("stored", "made").alias("payload"))
    fresh = made.where("made is not null and made not in ('', '[]', '{}')").select("key", F.col("made").alias("payload"), F.lit(float(now)).alias("written_at"))
    return answers, fresh


def store_cache(fresh: DataFrame, base: str) -> None:
    """Append answers to the stored cache; the latest of a key counts when it is read."""
    fresh.select(*struct(CACHE).fieldNames()).write.mode("append").parquet(os.path.join(base, "cache"))


def stored_cache(spark: SparkSession, base: str) -> DataFrame:
    """The stored cache, of each key the latest answer."""
    rows = read_table(spark, os.path.join(base, "cache"), CACHE)
    return rows.groupBy("key").agg(F.max_by("payload", "written_at").alias("payload"), F.max("written_at").alias("written_at"))


# ---- the whole report -------------------------------------------------------

def metrics_bundle(logs: DataFrame, metrics: DataFrame, now: float, days: int, n: int) -> DataFrame:
    """All reports as rows of JSON: section (summary, grades, strategies, timeseries, recent, cache), payload.

    Each section is small by itself: one row, known grades, lists of retrievers, hours, or the latest ``n``.
    """
    row = lambda df, section: df.select(F.lit(section).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))
    parts = {"grades": grade_mix(logs), "strategies": strategy_mix(logs), "timeseries": timeseries(logs, metrics, now, days), "recent": recent(logs, metrics, n), "cache": cache_totals(cache_replay(logs))}
    out = row(summary(logs, metrics), "summary")
    for section, df in parts.items():
        out = out.unionByName(row(df, section))
    return out
