"""The pN_ queries: each problem's operator over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlode.llm.distinctive import distinctive_terms
from lexlode.llm.mixing import mix_sources
from lexlode.llm.names import entity_names, name_pairs
from lexlode.llm.near_duplicates import near_duplicates
from lexlode.llm.packing import fill_report, pack_texts
from lexlode.llm.pair_defects import pair_defects
from lexlode.llm.percentiles import merge, percentiles, sketch
from lexlode.llm.rendering import furniture_lines, main_content
from lexlode.llm.sentences import sentence_units
from lexlode.llm.splitting import split_oversized
from lexlode.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(table(spark, sf_dir, "eval_inputs"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_id"), "text")
    kinds = F.array(F.struct(F.lit("chunk").alias("item_kind"), "text"), F.struct(F.lit("parent").alias("item_kind"), F.col("parent_text").alias("text")))
    chunks = table(spark, sf_dir, "chunks").select(F.col("chunk_id").alias("item_id"), F.explode(kinds).alias("x")).select("x.item_kind", "item_id", "x.text")
    return split_oversized(docs.unionByName(chunks), table(spark, sf_dir, "size_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 1").select("item_kind", "item_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distinctive_terms(table(spark, sf_dir, "chunks"), min_tf=4, min_df=2, max_df=6)
    return found.where((F.col("n_chars") <= 2000) & (F.length("term") >= 4)).select("chunk_id", "term")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = distinctive_terms(table(spark, sf_dir, "chunks"))
    return scored.select("chunk_id", "term", "tf", "df", F.round("score", 9).alias("score"))


def p3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most distinctive terms of each chunk; terms of one score in their order."""
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), "term"))
    return p3_scores(spark, sf_dir).withColumn("place", place).where("place <= 5").select("chunk_id", "place", "term", "score")


METRICS = ["latency_ms", "top_chunk_score"]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "query_logs").select("id", "timestamp", "model", "intent", *METRICS).dropDuplicates(["id"])
    return sketch(logs.withColumn("day", F.floor(F.col("timestamp") / 86400)), ["day", "model", "intent"], METRICS)


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["model", "intent"]
    got = percentiles(merge(_daily(spark, sf_dir), by), by, [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])
    return got.withColumn("estimate", F.round("estimate", 6))


def p6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


def _typed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "triples").select(F.explode(F.array("subject", "object")).alias("name"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(entity_names(_typed_names(spark, sf_dir)))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_names(_typed_names(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no")


def p4_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_content(table(spark, sf_dir, "documents"))


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """Containers of size_limits, a fixed table."""
    rows = table(spark, sf_dir, "size_limits").where("unit = 'tokens' and item_kind like 'container%'").orderBy("item_kind").collect()
    return [(r.item_kind, r.max_size) for r in rows]


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), _capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p8_containers(spark, sf_dir), _capacities(spark, sf_dir))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates(table(spark, sf_dir, "documents")).pairs()
    return pairs.withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).classes().withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p3_top": p3_top,
    "p5_found": p5_found,
    "p5_entities": p5_entities,
    "p4_found": p4_found,
    "p4_main_content": p4_main_content,
    "p7_found": p7_found,
    "p6_percentiles": p6_percentiles,
    "p6_sketches": p6_sketches,
    "p7_classes": p7_classes,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_selection": p9_selection,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

_BUCKET = """CAST(sign(v) AS INTEGER) AS sign, CASE WHEN v = 0 THEN 0 ELSE CAST(ceil(ln(abs(v)) / ln(1.01e0 / 0.99e0)) AS INTEGER) END AS "index\""""
_DAILY = f"""WITH logs AS (SELECT DISTINCT ON (id) * FROM query_logs),
v AS (SELECT CAST(floor("timestamp" / 86400) AS BIGINT) AS day, model, intent, 'latency_ms' AS metric, latency_ms AS v FROM logs
      UNION ALL SELECT CAST(floor("timestamp" / 86400) AS BIGINT), model, intent, 'top_chunk_score', top_chunk_score FROM logs),
b AS (SELECT day, model, intent, metric, {_BUCKET}, count(*) AS n FROM v WHERE v IS NOT NULL AND isfinite(v) GROUP BY ALL)"""

_TERMS = r"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
t AS (SELECT chunk_id, unnest(string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_-]+', ' ', 'g')), ' ')) AS term FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL),
b AS (SELECT term, count(*) AS df, sum(tf) / (SELECT sum(tf) FROM tf)::DOUBLE AS bg FROM tf GROUP BY term),
l AS (SELECT chunk_id, term, tf, df, bg, tf / bg AS lead FROM tf JOIN b USING (term)),
m AS (SELECT *, sum(tf) OVER w / (1 + 9 * sum(bg) OVER w) AS mu FROM l WINDOW w AS (PARTITION BY chunk_id ORDER BY lead DESC)),
k AS (SELECT *, min(mu) FILTER (WHERE lead > 9 * mu) OVER (PARTITION BY chunk_id) AS low, max(mu) FILTER (WHERE lead > 9 * mu) OVER (PARTITION BY chunk_id) AS high FROM m),
s AS (SELECT chunk_id, term, CAST(tf AS INTEGER) AS tf, df, round(greatest(0, tf / high - 9 * bg), 9) + 0e0 AS score FROM k)"""

ORACLE: dict[str, str] = {
    "p3_scores": _TERMS + " SELECT * FROM s",
    "p3_top": _TERMS + ", r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) AS place FROM s) SELECT chunk_id, CAST(place AS INTEGER) AS place, term, score FROM r WHERE place <= 5",
    "p2_found": """
WITH items AS (SELECT 'document' AS item_kind, CAST(doc_id AS VARCHAR) AS item_id, text FROM documents
               UNION ALL SELECT 'chunk', chunk_id, text FROM chunks UNION ALL SELECT 'parent', chunk_id, parent_text FROM chunks)
SELECT DISTINCT item_kind, item_id FROM items JOIN size_limits USING (item_kind) WHERE unit = 'chars' AND length(text) > max_size""",
    "p3_found": r"""
WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunks WHERE text IS NOT NULL),
t AS (SELECT chunk_id, length(text) AS n_chars, unnest(string_split_regex(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_-]+', ' ', 'g')), ' ')) AS term FROM c),
tf AS (SELECT chunk_id, n_chars, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE n_chars <= 2000 AND tf >= 4 AND df BETWEEN 2 AND 6 AND length(term) >= 4""",
    "p6_sketches": _DAILY + " SELECT * FROM b",
    "p6_percentiles": _DAILY + """,
m AS (SELECT model, intent, metric, sign, "index", sum(n) AS n FROM b GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY model, intent, metric ORDER BY sign, sign * "index" ROWS UNBOUNDED PRECEDING) AS upto,
             sum(n) OVER (PARTITION BY model, intent, metric) AS total FROM m),
q AS (SELECT unnest([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 0.95e0, 0.99e0]) AS quantile)
SELECT model, intent, metric, CAST(total AS BIGINT) AS n, quantile, round(sign * exp("index" * ln(1.01e0 / 0.99e0)) * 0.99e0, 6) AS estimate
FROM r, q WHERE upto > floor(quantile * (total - 1)) AND upto - n <= floor(quantile * (total - 1))""",
}
