"""Queries over judged metrics and requests, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions import text as X
from lexlode.operators import models as M
from lexlode.operators.lexical import distinct_chunks
from lexlode.plans.answering import ORACLE as ANSWER_SQL
from lexlode.plans.answering import ranked
from lexlode.plans.reporting import logs
from lexlode.plans.retrieval import RERANK_SQL
from lexlode.plans.text import sentences_sql, terms_sql
from lexlode.sources.tables import table

CFG = Settings()


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "eval_inputs").where("answer is not null").select("pair_id", "query", "answer", X.sentences("answer").alias("claim"), "chunk_ids")


def faithfulness(spark, sf_dir):
    claims = M.claims_by_overlap(_pairs(spark, sf_dir), distinct_chunks(table(spark, sf_dir, "chunks")))
    return M.faithfulness(claims).select("pair_id", F.round("faithfulness", 9).alias("faithfulness"))


def context_precision(spark, sf_dir):
    marks = M.marks_by_overlap(_pairs(spark, sf_dir), distinct_chunks(table(spark, sf_dir, "chunks")))
    return M.context_precision(marks).select("pair_id", F.round("context_precision", 9).alias("context_precision"))


def answer_relevancy(spark, sf_dir):
    return M.answer_relevancy(_pairs(spark, sf_dir)).select("pair_id", F.round("answer_relevancy", 9).alias("answer_relevancy"))


def request_validation(spark, sf_dir):
    _, bad = M.validate_requests(logs(spark, sf_dir).select("id", "query", (F.col("id") % 23).cast("int").alias("top_k")))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def grader_passages(spark, sf_dir):
    return M.grader_passages(ranked(spark, sf_dir))


def query_turns(spark, sf_dir):
    """Queries of each model in the order of arrival, with the one before."""
    t = logs(spark, sf_dir).select("id", F.concat_ws("/", F.coalesce("model", F.lit("")), F.floor(F.col("timestamp") / 86400).cast("string")).alias("conv_id"), F.col("id").alias("turn"), F.col("query").alias("text"))
    return M.replay(t).select("id", F.col("number").cast("long").alias("number"), "before")


def evaluate_answers(spark, sf_dir):
    """Metric rows of the logged answers that have none yet."""
    pairs = table(spark, sf_dir, "eval_inputs").select("pair_id", "query_log_id", "query", "answer", "chunk_ids")
    scores = logs(spark, sf_dir).select(F.col("id").alias("query_log_id"), F.col("top_chunk_score").alias("mean_chunk_score"))
    rows = M.evaluate(pairs, table(spark, sf_dir, "chunks"), scores, table(spark, sf_dir, "eval_metrics"), 0.0)
    return rows.select("query_log_id", *(F.round(c, 9).alias(c) for c in ("faithfulness", "answer_relevancy", "context_precision", "context_utilisation", "mean_chunk_score")))


QUERIES = {f.__name__: f for f in (faithfulness, context_precision, answer_relevancy, evaluate_answers, request_validation, grader_passages, query_turns)}

_P = f"p AS (SELECT pair_id, query, answer, {sentences_sql('answer')} AS claims, chunk_ids FROM eval_inputs WHERE answer IS NOT NULL)"
_C = f"c AS (SELECT DISTINCT ON (chunk_id) chunk_id, {terms_sql('text')} AS t FROM chunks)"
ORACLE = {
    "faithfulness": f"""WITH {_P}, {_C}, u AS (SELECT DISTINCT pair_id, unnest(chunk_ids) AS chunk_id FROM p), x AS (SELECT pair_id, list_distinct(flatten(list(t))) AS ctx FROM u JOIN c USING (chunk_id) GROUP BY 1),
        cl AS (SELECT pair_id, list_distinct({terms_sql('claim')}) AS t FROM (SELECT pair_id, unnest(claims) AS claim FROM p)), k AS (SELECT pair_id, CAST(len(list_intersect(t, coalesce(ctx, []))) AS DOUBLE) / len(t) >= 0.5 AS ok FROM cl LEFT JOIN x USING (pair_id) WHERE len(t) > 0)
        SELECT pair_id, round(avg(ok::INT), 9) AS faithfulness FROM k GROUP BY 1""",
    "context_precision": f"""WITH {_P}, {_C}, u AS (SELECT pair_id, {terms_sql('query')} AS q, unnest(chunk_ids) AS chunk_id FROM p)
        SELECT pair_id, round(avg((len(list_intersect(q, t)) > 0)::INT), 9) AS context_precision FROM u JOIN c USING (chunk_id) GROUP BY 1""",
    "answer_relevancy": f"""WITH {_P}, w AS (SELECT pair_id, 'q' AS side, unnest({terms_sql('query')}) AS t FROM p UNION ALL SELECT pair_id, 'a', unnest({terms_sql('answer')}) FROM p),
        b AS (SELECT pair_id, side, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {CFG.embed_dim} AS k, CAST(count(*) AS DOUBLE) AS c FROM w GROUP BY ALL),
        n AS (SELECT pair_id, side, sqrt(sum(c * c)) AS n FROM b GROUP BY ALL), d AS (SELECT x.pair_id, sum(x.c * y.c) AS d FROM b x JOIN b y ON x.pair_id = y.pair_id AND x.k = y.k AND x.side = 'q' AND y.side = 'a' GROUP BY 1)
        SELECT p.pair_id, round(coalesce(d / (x.n * y.n), 0), 9) AS answer_relevancy FROM p LEFT JOIN d USING (pair_id) LEFT JOIN n x ON x.pair_id = p.pair_id AND x.side = 'q' LEFT JOIN n y ON y.pair_id = p.pair_id AND y.side = 'a'""",
    "request_validation": """WITH l AS (SELECT DISTINCT ON (id) id, query FROM query_logs), r AS (SELECT CASE WHEN query IS NULL OR length(query) < 3 THEN 'query too short' WHEN length(query) > 2048 THEN 'query too long'
        WHEN id % 23 < 1 OR id % 23 > 20 THEN 'top_k out of range' END AS reason FROM l) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "grader_passages": f"WITH {RERANK_SQL} SELECT query_id, string_agg('[' || rank || '] ' || substr(text, 1, 400), chr(10) || chr(10) ORDER BY rank) AS passages FROM final WHERE rank <= 5 GROUP BY 1",
    "query_turns": """WITH l AS (SELECT DISTINCT ON (id) * FROM query_logs) SELECT id, row_number() OVER w AS number, lag(query) OVER w AS before FROM l WINDOW w AS (PARTITION BY coalesce(model, '') || '/' || CAST(floor("timestamp" / 86400) AS BIGINT) ORDER BY id)""",
}
UTILISATION_SQL = ANSWER_SQL["context_utilisation"]
ORACLE["evaluate_answers"] = f"""WITH f AS ({ORACLE["faithfulness"]}), a AS ({ORACLE["answer_relevancy"]}), x AS ({ORACLE["context_precision"]}), u AS ({UTILISATION_SQL}),
w AS (SELECT query_log_id, min(pair_id) AS pair_id FROM eval_inputs WHERE answer IS NOT NULL AND query_log_id NOT IN (SELECT query_log_id FROM eval_metrics) GROUP BY 1),
s AS (SELECT DISTINCT ON (id) id, round(top_chunk_score, 9) AS mean_chunk_score FROM query_logs)
SELECT query_log_id, faithfulness, answer_relevancy, context_precision, round(context_utilisation, 9) AS context_utilisation, mean_chunk_score
FROM w LEFT JOIN f USING (pair_id) LEFT JOIN a USING (pair_id) LEFT JOIN x USING (pair_id) LEFT JOIN u USING (pair_id) LEFT JOIN s ON s.id = query_log_id"""
