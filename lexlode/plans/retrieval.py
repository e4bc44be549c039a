"""Queries over the lexical and vector indexes and their fusion, with SQL twins.

Searches take every logged query, or vector, whose id is divisible by 100,
against all rows.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.operators import fusion, lexical, vectors
from lexlode.plans.text import terms_sql
from lexlode.session import shared_dir
from lexlode.sources.tables import table

CFG = Settings()
K, FINAL = CFG.retrieval_top_k, CFG.final_top_k


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged queries whose id is divisible by 100: query_id, query."""
    logs = table(spark, sf_dir, "query_logs").where((F.col("id") % 100 == 0) & F.col("query").isNotNull())
    return logs.select(F.col("id").alias("query_id"), "query").dropDuplicates(["query_id"])


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def bm25_postings(spark, sf_dir):
    return lexical.postings(table(spark, sf_dir, "chunks"))


def bm25_term_stats(spark, sf_dir):
    c = table(spark, sf_dir, "chunks")
    post = lexical.postings(c)
    return lexical.term_stats(post, lexical.doc_stats(c, post)).withColumn("idf", F.round("idf", 9))


def bm25_search(spark, sf_dir):
    hits = lexical.bm25_search(queries(spark, sf_dir), table(spark, sf_dir, "chunks"), K)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def dense_topk(spark, sf_dir):
    """The neighbours of one stored vector, by plain column functions."""
    s = stored(spark, sf_dir)
    q = s.where("vec_id = 0").select(F.col("embedding").alias("q"))
    dot = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scored = s.join(F.broadcast(q)).select("vec_id", "label", F.round(dot / (length("embedding") * length("q")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(K)


def dense_topk_batch(spark, sf_dir):
    hits = vectors.dense_search(vector_queries(spark, sf_dir), stored(spark, sf_dir), K)
    return hits.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def ivf_topk(spark, sf_dir):
    """Clustered search that visits every cell, so that it must equal the exact one."""
    hits = vectors.ivf_search(vector_queries(spark, sf_dir), stored(spark, sf_dir), K, CFG.nlist, CFG.nlist)
    return hits.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def ivf_pruned(spark, sf_dir):
    """Clustered search that visits 4 of 16 cells, read from their folders; the centroids are the first 16 vectors."""
    s = stored(spark, sf_dir)
    c = np.array([r.embedding for r in s.where("vec_id < 16").orderBy("vec_id").collect()], dtype=float)  # 16 rows
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    vectors.write_cells(s, c, path)
    hits = vectors.ivf_search(vector_queries(spark, sf_dir), spark.read.parquet(path), K, 16, 4, c)
    return hits.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def ivf_recall(spark, sf_dir):
    """Share of the exact neighbours that the clustered search finds, by number of cells visited."""
    q, s = vector_queries(spark, sf_dir), stored(spark, sf_dir)
    exact = vectors.dense_search(q, s, K).select("query_id", "vec_id")
    c = vectors.train_centroids(s, CFG.nlist)
    out = None
    for probe in (CFG.nprobe, CFG.nlist // 2, 3 * CFG.nlist // 4, CFG.nlist):
        near = vectors.ivf_search(q, s, K, CFG.nlist, probe, c).select("query_id", "vec_id", F.lit(1).alias("hit"))
        one = exact.join(near, ["query_id", "vec_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall")).withColumn("nprobe", F.lit(probe))
        out = one if out is None else out.unionByName(one)
    return out


def vector_stats(spark, sf_dir):
    return vectors.vector_stats(stored(spark, sf_dir))


def retrieved_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of two lexical retrievers over the same queries: chunk texts and parent windows."""
    q, c = queries(spark, sf_dir), table(spark, sf_dir, "chunks")
    a = lexical.bm25_search(q, c, K).withColumn("retriever", F.lit("bm25"))
    b = lexical.bm25_search(q, c.withColumn("text", F.coalesce("title", F.lit(""))), K).withColumn("retriever", F.lit("title"))
    return a.unionByName(b).select("query_id", "chunk_id", "score", "retriever")


def rrf_fusion(spark, sf_dir):
    fused = fusion.rrf_fuse(retrieved_lists(spark, sf_dir), CFG.rrf_k, K)
    return fused.select("query_id", "chunk_id", "retriever", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def rrf_best_row(spark, sf_dir):
    fused = fusion.rrf_fuse(retrieved_lists(spark, sf_dir), CFG.rrf_k)
    return fused.select("query_id", "chunk_id", "best_retriever", F.round("best_score", 6).alias("best_score"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lexical.distinct_chunks(table(spark, sf_dir, "chunks")).select("chunk_id", "source", "title", "text", "parent_text", "chunk_index")
    fused = fusion.rrf_fuse(retrieved_lists(spark, sf_dir), CFG.rrf_k, K)
    return fused.join(c, "chunk_id").join(queries(spark, sf_dir), "query_id")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(candidates(spark, sf_dir), FINAL)


def rerank_topk(spark, sf_dir):
    return reranked(spark, sf_dir).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (bm25_postings, bm25_term_stats, bm25_search, dense_topk, dense_topk_batch, ivf_topk, ivf_pruned, ivf_recall, vector_stats, rrf_fusion, rrf_best_row, rerank_topk)}

Q_SQL = "q AS (SELECT DISTINCT ON (id) id AS query_id, query FROM query_logs WHERE id % 100 = 0 AND query IS NOT NULL)"


def index_sql(name: str, text: str) -> str:
    """Tables of one lexical index over a text expression: <name>_c, _post, _dl, _ts."""
    return f"""{name}_c AS (SELECT DISTINCT ON (chunk_id) chunk_id, {terms_sql(text)} AS l FROM chunks),
{name}_post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(l) AS term FROM {name}_c) GROUP BY ALL),
{name}_dl AS (SELECT chunk_id, len(l) AS dl FROM {name}_c),
{name}_raw AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM {name}_dl) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {name}_post GROUP BY term),
{name}_ts AS (SELECT term, df, CASE WHEN raw < 0 THEN {CFG.bm25_epsilon} * (SELECT avg(raw) FROM {name}_raw) ELSE raw END AS idf FROM {name}_raw)"""


def search_sql(name: str, k: int, q: str = "q", tag: str = "") -> str:
    """Search of the queries ``q`` in one index: <name><tag>_hits with query_id, chunk_id, score, rank."""
    k1, b = CFG.bm25_k1, CFG.bm25_b
    out = name + tag
    return f"""{out}_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms_sql('query')}) AS term FROM {q}) GROUP BY ALL),
{out}_s AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / (SELECT avg(dl) FROM {name}_dl)))) AS raw
  FROM {name}_post JOIN {out}_qt USING (term) JOIN {name}_ts USING (term) JOIN {name}_dl USING (chunk_id) GROUP BY ALL),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, chunk_id) AS rank FROM {out}_s WHERE raw > 0),
{out}_hits AS (SELECT query_id, chunk_id, rank, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM {out}_r WHERE rank <= {k})"""


LISTS_SQL = f"""{Q_SQL}, {index_sql('t', "coalesce(text, '')")}, {search_sql('t', K)}, {index_sql('h', "coalesce(title, '')")}, {search_sql('h', K)},
lists AS (SELECT query_id, chunk_id, score, 'bm25' AS retriever FROM t_hits UNION ALL SELECT query_id, chunk_id, score, 'title' FROM h_hits)"""
FUSE_SQL = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM lists),
fused AS (SELECT query_id, chunk_id, sum(1e0 / ({CFG.rrf_k} + rank)) AS score, string_agg(retriever, '+' ORDER BY retriever) AS retriever,
  arg_max(retriever, round(score, 9) * 1000 - ascii(retriever) / 1e6) AS best_retriever, max(score) AS best_score FROM ranked GROUP BY query_id, chunk_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) WHERE rank <= {K})"""
LISTS_SQL += "," + FUSE_SQL
CONTEXT_SQL = f""",
ctx AS (SELECT DISTINCT ON (chunk_id) chunk_id, source, title, text, parent_text, coalesce(nullif(parent_text, ''), text) AS ctx FROM chunks),
pair AS (SELECT top.*, top.score AS rrf, query, source, title, text, parent_text, list_distinct({terms_sql('query')}) AS ql, {terms_sql('ctx')} AS cl FROM top JOIN ctx USING (chunk_id) JOIN q USING (query_id)),
sc AS (SELECT *, CASE WHEN len(ql) > 0 THEN CAST(len(list_intersect(ql, cl)) AS DOUBLE) / len(ql) ELSE 0 END AS new FROM pair),
best AS (SELECT * EXCLUDE (rank, score, new), new AS score, rank AS fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY round(new, 9) DESC, rank, chunk_id) AS rank FROM sc),
final AS (SELECT * FROM best WHERE rank <= {FINAL})"""
RERANK_SQL = LISTS_SQL + CONTEXT_SQL
_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_COS = f"{_DOT.format('s.embedding', 'x.embedding')} / (sqrt({_DOT.format('s.embedding', 's.embedding')}) * sqrt({_DOT.format('x.embedding', 'x.embedding')}))"
_DENSE = f"""WITH p AS (SELECT x.vec_id AS query_id, s.vec_id, {_COS} AS score FROM embeddings x, embeddings s WHERE x.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}"""
ORACLE = {
    "bm25_postings": f"WITH {index_sql('t', 'text')} SELECT * FROM t_post",
    "bm25_term_stats": f"WITH {index_sql('t', 'text')} SELECT term, df, round(idf, 9) AS idf FROM t_ts",
    "bm25_search": f"WITH {Q_SQL}, {index_sql('t', 'text')}, {search_sql('t', K)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM t_hits",
    "dense_topk": f"SELECT s.vec_id, s.label, round({_COS}, 6) AS score FROM embeddings s, embeddings x WHERE x.vec_id = 0 ORDER BY score DESC, s.vec_id LIMIT {K}",
    "dense_topk_batch": _DENSE,
    "ivf_topk": _DENSE,
    "ivf_pruned": f"""WITH x AS (SELECT * FROM embeddings WHERE vec_id < 16), m AS (SELECT s.vec_id, x.vec_id AS cell, {_COS} AS sim FROM embeddings s, x),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cell) AS r FROM m), near AS (SELECT vec_id, cell FROM o WHERE r = 1),
p AS (SELECT x.vec_id AS query_id, s.vec_id, {_COS} AS score FROM embeddings x, embeddings s JOIN near USING (vec_id)
  WHERE x.vec_id % 100 = 0 AND (x.vec_id, near.cell) IN (SELECT vec_id, cell FROM o WHERE r <= 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}""",
    "vector_stats": f"SELECT label, count(*) AS n, round(min(sqrt({_DOT.format('embedding', 'embedding')})), 6) AS min_norm, round(max(sqrt({_DOT.format('embedding', 'embedding')})), 6) AS max_norm, max(len(embedding)) AS dim FROM embeddings GROUP BY label",
    "rrf_fusion": f"WITH {LISTS_SQL} SELECT query_id, chunk_id, retriever, rank, round(score, 9) AS score FROM top",
    "rrf_best_row": f"WITH {LISTS_SQL} SELECT query_id, chunk_id, best_retriever, round(best_score, 6) AS best_score FROM fused",
    "rerank_topk": f"WITH {RERANK_SQL} SELECT query_id, chunk_id, rank, round(score, 9) AS score FROM final",
}
