"""Queries over the text functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.functions import text as X
from lexlode.sources.tables import table

SPACE = X.SPACE
STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.clean_text("text").alias("clean"))


def doc_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.short_hash("source", "doc_id").alias("doc_key"))


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.token_estimate("text").cast("long").alias("tokens"))


def tokenize(spark, sf_dir):
    terms = X.index_terms("text")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(terms, " ").alias("terms"), F.size(terms).cast("long").alias("n_terms"))


def snippets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *(X.snippet("text", n).alias(f"s{n}") for n in (200, 175, 160)))


def title_case(spark, sf_dir):
    t = table(spark, sf_dir, "triples")
    return t.select(F.explode(F.array("subject", "object")).alias("name")).where("name is not null").distinct().select("name", X.title_case("name").alias("title"))


def basename(spark, sf_dir):
    path = F.concat_ws("/", F.lit("in"), F.col("source"), F.concat_ws(".", F.concat_ws("_", F.col("source"), F.col("doc_id").cast("string")), F.col("doc_type")))
    return _docs(spark, sf_dir).select("doc_id", X.basename(path).alias("file"), X.stem_title(path).alias("title"))


def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def display_values(spark, sf_dir):
    logs = table(spark, sf_dir, "query_logs").dropDuplicates(["id"])
    return logs.select(
        "id", X.strategy_label("strategies").alias("label"), X.score_percent("top_chunk_score").cast("long").alias("percent"),
        X.html_escape("query").alias("safe_query"), X.number_or_dash(F.col("num_chunks").cast("double")).alias("chunks"))


def linked_answers(spark, sf_dir):
    e = table(spark, sf_dir, "eval_inputs").where("answer is not null")
    return e.select("pair_id", X.link_citations("answer", F.size("chunk_ids")).alias("linked"))


QUERIES = {f.__name__: f for f in (clean_text, doc_ids, token_estimate, tokenize, snippets, title_case, basename, sentences, display_values, linked_answers)}

_STRIP = f"'^[{SPACE}]+|[{SPACE}]+$', '', 'g'"


def title_sql(e: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({e}, '\\p{{L}}+|\\P{{L}}+'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), 'string_agg', '')"


def terms_sql(e: str) -> str:
    words = f"string_split(trim(regexp_replace(lower({e}), '[^\\p{{L}}\\p{{N}}_-]+', ' ', 'g')), ' ')"
    return f"list_filter({words}, lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


def sentences_sql(e: str) -> str:
    parts = f"string_split(regexp_replace({e}, '([.!?])[{SPACE}]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda s: regexp_replace(s, {_STRIP})), lambda s: s <> '')"


_N = "CAST(regexp_extract(p, '^\\[(\\d{1,9})\\]$', 1) AS INTEGER)"
ORACLE = {
    "linked_answers": f"""SELECT pair_id, array_to_string(list_transform(regexp_extract_all(answer, '\\[\\d{{1,9}}\\]|[^\\[]+|\\['),
        lambda p: CASE WHEN regexp_matches(p, '^\\[\\d{{1,9}}\\]$') THEN CASE WHEN {_N} BETWEEN 1 AND len(chunk_ids) THEN '[[' || {_N} || ']](#cite-' || {_N} || ')' ELSE p END ELSE p END), '') AS linked
        FROM eval_inputs WHERE answer IS NOT NULL""",
    "clean_text": rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\n{{3,}}', chr(10) || chr(10), 'g'),
        '[ \t]{{2,}}', ' ', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), {_STRIP}) AS clean FROM documents""",
    "doc_ids": "SELECT doc_id, substr(sha256(source || ':' || doc_id), 1, 16) AS doc_key FROM documents",
    "token_estimate": "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents",
    "tokenize": f"WITH t AS (SELECT doc_id, {terms_sql('text')} AS l FROM documents) SELECT doc_id, coalesce(array_to_string(l, ' '), '') AS terms, len(l) AS n_terms FROM t",
    "snippets": "SELECT doc_id, substr(text, 1, 200) AS s200, substr(text, 1, 175) AS s175, substr(text, 1, 160) AS s160 FROM documents",
    "title_case": f"WITH n AS (SELECT subject AS name FROM triples UNION SELECT object FROM triples) SELECT name, coalesce({title_sql('name')}, '') AS title FROM n WHERE name IS NOT NULL",
    "basename": f"""WITH p AS (SELECT doc_id, source || '_' || doc_id || '.' || doc_type AS file FROM documents)
        SELECT doc_id, file, {title_sql("translate(regexp_replace(file, '\\.[^.]*$', ''), '_-', '  ')")} AS title FROM p""",
    "sentences": f"WITH s AS (SELECT doc_id, {sentences_sql('text')} AS l FROM documents) SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM s",
    "display_values": """SELECT DISTINCT ON (id) id, upper(array_to_string(CAST(from_json(strategies, '["VARCHAR"]') AS VARCHAR[]), '+')) AS label,
        CAST(round(least(greatest(top_chunk_score, 0), 1) * 100) AS BIGINT) AS percent,
        replace(replace(replace(replace(replace(query, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe_query,
        CASE WHEN num_chunks IS NULL OR num_chunks = 0 THEN '—' ELSE printf('%.2f', num_chunks::DOUBLE) END AS chunks FROM query_logs""",
}
