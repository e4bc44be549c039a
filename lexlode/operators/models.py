"""Plug-in points for models: one contract, loaded once per worker, offline stand-ins by default."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import index_terms, sentences
from lexlode.operators.answering import context_utilisation
from lexlode.operators.orchestrate import embed_column, query_text  # noqa: F401
from lexlode.schemas import EVAL_METRIC, struct
from lexlode.session import cut

Loader = Callable[[], Callable[[list[tuple]], list[str | None]]]


def model_column(df: DataFrame, key: str, inputs: list[str], load: Loader, out: str = "response", batch: int = 8, per_minute: int | None = None, chars: int | None = None) -> DataFrame:
    """Responses of a model to rows: key, ``out``. A batch that fails gives nulls, not an error.

    ``load`` runs once per task and returns a function from input tuples to
    responses; ``per_minute`` bounds the calls of each task; ``chars`` cuts each input.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        model, last = load(), 0.0
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns[1:])))
            got: list[str | None] = []
            for i in range(0, len(rows), batch):
                if per_minute:
                    time.sleep(max(0.0, last + 60 / per_minute - time.monotonic()))
                    last = time.monotonic()
                try:
                    got += model(rows[i : i + batch])
                except Exception:  # the caller's defaults stand in for a failed call
                    got += [None] * len(rows[i : i + batch])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["key", "response"])

    cut = [F.substring(c, 1, chars).alias(c) if chars else F.col(c) for c in inputs]
    return df.select(F.col(key).alias("key"), *cut).mapInArrow(run, f"key {kind}, response string").withColumnsRenamed({"key": key, "response": out})


def scored_pairs(pairs: DataFrame, load: Loader, fallback: str = "score") -> DataFrame:
    """Scores of (query, text) pairs by a cross-encoder; where it fails, the score so far stays."""
    keyed = pairs.withColumn("pair", F.concat_ws("\u0001", F.col("query_id").cast("string"), "chunk_id"))
    scores = model_column(keyed, "pair", ["query", "text"], load)
    return keyed.join(scores, "pair", "left").withColumn("score", F.coalesce(F.try_to_number("response", F.lit("S999999D999999")).cast("double"), F.col(fallback))).drop("pair", "response")


# ---- judged metrics ---------------------------------------------------------

def faithfulness(claims: DataFrame) -> DataFrame:
    """Share of an answer's claims that the context supports: pair_id, faithfulness. ``claims``: pair_id, supported."""
    return claims.groupBy("pair_id").agg(F.avg(F.col("supported").cast("double")).alias("faithfulness"))


def context_precision(marks: DataFrame) -> DataFrame:
    """Share of an answer's passages that are relevant: pair_id, context_precision. ``marks``: pair_id, relevant."""
    return marks.groupBy("pair_id").agg(F.avg(F.col("relevant").cast("double")).alias("context_precision"))


def claims_by_overlap(pairs: DataFrame, chunks: DataFrame, floor: float = 0.5) -> DataFrame:
    """Claims of answers and whether their chunks hold at least ``floor`` of each one's terms: the offline judge.

    ``pairs``: pair_id, answer sentences (``claim`` array), chunk_ids. A pair's chunks are few, so its terms are.
    """
    used = pairs.select("pair_id", F.explode("chunk_ids").alias("chunk_id")).distinct().join(chunks.select("chunk_id", index_terms("text").alias("t")), "chunk_id")
    context = used.groupBy("pair_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("context"))
    each = pairs.select("pair_id", F.posexplode("claim").alias("pos", "claim")).withColumn("terms", F.array_distinct(index_terms("claim"))).where(F.size("terms") > 0)
    held = F.size(F.array_intersect("terms", F.coalesce("context", F.array().cast("array<string>")))) / F.size("terms")
    return each.join(context, "pair_id", "left").select("pair_id", "pos", "claim", (held >= floor).alias("supported"))


def marks_by_overlap(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether each passage of a pair shares a term with its query: the offline judge."""
    used = pairs.select("pair_id", "query", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
    return used.select("pair_id", "chunk_id", (F.size(F.array_intersect(index_terms("query"), index_terms("text"))) > 0).alias("relevant"))


def answer_relevancy(pairs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Cosine of the query's and the answer's vectors: pair_id, answer_relevancy; 0 if one is empty."""
    q = embed_column(pairs, "pair_id", "query", cfg).withColumnsRenamed({"id": "pair_id", "embedding": "q"})
    a = embed_column(pairs, "pair_id", "answer", cfg).withColumnsRenamed({"id": "pair_id", "embedding": "a"})
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(total("q", "q")) * F.sqrt(total("a", "a"))
    return q.join(a, "pair_id").select("pair_id", F.when(norm > 0, total("q", "a") / norm).otherwise(0.0).alias("answer_relevancy"))


def answer_relevancy_by_questions(pairs: DataFrame, load: Loader, cfg: Settings = Settings()) -> DataFrame:
    """Mean cosine of the query and the questions that a model makes of the answer: pair_id, answer_relevancy.

    ``load`` gives a function from (answer,) tuples to questions, one a line. A pair for
    which none could be made scores by its answer itself, as ``answer_relevancy`` does.
    """
    made = model_column(pairs.where("answer is not null"), "pair_id", ["answer"], load, out="made")
    each = made.select("pair_id", F.posexplode(F.filter(F.split("made", "\n"), lambda x: F.trim(x) != "")).alias("pos", "question"))
    asked = each.join(pairs.select("pair_id", "query"), "pair_id").withColumn("both", F.concat_ws("\u0001", F.col("pair_id").cast("string"), "pos"))
    one = answer_relevancy(asked.select(F.col("both").alias("pair_id"), "query", F.col("question").alias("answer")), cfg)
    mean = one.join(asked.select(F.col("both").alias("pair_id"), F.col("pair_id").alias("of")), "pair_id").groupBy(F.col("of").alias("pair_id")).agg(F.avg("answer_relevancy").alias("mean"))
    return answer_relevancy(pairs, cfg).join(mean, "pair_id", "left").select("pair_id", F.coalesce("mean", "answer_relevancy").alias("answer_relevancy"))


def evaluate(pairs: DataFrame, chunks: DataFrame, scores: DataFrame, metrics: DataFrame, now: float, cfg: Settings = Settings(), load: Loader | None = None) -> DataFrame:
    """Metric rows (schema EVAL_METRIC) of the logged answers that have none yet; nothing if evaluation is off.

    ``pairs``: pair_id, query_log_id, query, answer, chunk_ids; ``scores``: query_log_id, mean_chunk_score;
    ``metrics``: the rows so far. A log answered twice is evaluated once, by its lesser
    pair_id. A metric that a pair gives no ground for is null. With ``load`` the relevancy is
    judged by questions made of the answer.
    """
    work = pairs.where("answer is not null and query_log_id is not null").join(metrics.select("query_log_id").distinct(), "query_log_id", "left_anti")
    work = work.limit(0) if not cfg.eval_enabled else work
    first = work.groupBy("query_log_id").agg(F.min("pair_id").alias("pair_id"))
    work = cut(work.join(first, ["query_log_id", "pair_id"]).select("pair_id", "query_log_id", "query", "answer", "chunk_ids", sentences("answer").alias("claim")), "evaluate-work")
    once = chunks.dropDuplicates(["chunk_id"])
    relevancy = answer_relevancy_by_questions(work, load, cfg) if load else answer_relevancy(work, cfg)
    used = work.select("pair_id", context_utilisation("answer", F.size("chunk_ids")).alias("context_utilisation"))
    rows = work.select("pair_id", "query_log_id")
    for part in (faithfulness(claims_by_overlap(work, once)), relevancy, context_precision(marks_by_overlap(work, once)), used):
        rows = rows.join(part, "pair_id", "left")
    rows = rows.join(scores.groupBy("query_log_id").agg(F.min("mean_chunk_score").alias("mean_chunk_score")), "query_log_id", "left").withColumn("timestamp", F.lit(float(now)))
    return rows.withColumn("id", F.xxhash64("timestamp", "query_log_id").bitwiseAND(F.lit((1 << 62) - 1))).select(*struct(EVAL_METRIC).fieldNames())


# ---- requests and responses -------------------------------------------------

def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of requests (query, top_k): queries of 3 to 2048 characters, top_k of 1 to 20 or none."""
    n = F.length("query")
    reason = F.when(F.col("query").isNull() | (n < 3), "query too short").when(n > 2048, "query too long").when((F.col("top_k") < 1) | (F.col("top_k") > 20), "top_k out of range")
    marked = requests.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def grader_passages(ranked: DataFrame, most: int = 5, chars: int = 400) -> DataFrame:
    """Numbered passages as a judge sees them: the first five, 400 characters each."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring("text", 1, chars))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("v"))))
    return ranked.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["v"]), "\n\n").alias("passages"))


def replay(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns of conversations in order, each with the text before it and after it."""
    from pyspark.sql import Window

    w = Window.partitionBy(conversation).orderBy(turn)
    return turns.withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w), "number": F.row_number().over(w)})
