"""Queries over chunking, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.operators.chunking import chunk_documents, sentence_boundaries
from lexlode.plans.text import SPACE, sentences_sql, terms_sql
from lexlode.session import spread
from lexlode.sources.tables import table

CFG = Settings()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table in the engine's document schema."""
    d = table(spark, sf_dir, "documents")
    return spread(d.select(F.col("doc_key").alias("doc_id"), "source", "doc_type", "title", "text", F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("metadata")))


def adjacent_cosine(spark, sf_dir):
    return sentence_boundaries(documents(spark, sf_dir)).where("pos > 0").select("doc_id", "pos", F.round("similarity", 9).alias("similarity"))


def chunk_boundaries(spark, sf_dir):
    return sentence_boundaries(documents(spark, sf_dir)).where("starts").select("doc_id", "pos", "tokens")


def chunks(spark, sf_dir):
    return chunk_documents(documents(spark, sf_dir)).select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", F.col("metadata")["doc_type"].alias("doc_type"))


def chunk_offsets(spark, sf_dir):
    return chunk_documents(documents(spark, sf_dir), parents=False).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_index", "start_char", "end_char")))


def parent_windows(spark, sf_dir):
    return chunk_documents(documents(spark, sf_dir)).select("chunk_id", "parent_text")


def chunks_per_doc(spark, sf_dir):
    return chunk_documents(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


QUERIES = {f.__name__: f for f in (adjacent_cosine, chunk_boundaries, chunks, chunk_offsets, parent_windows, chunks_per_doc)}

_SIM = f"""WITH RECURSIVE s0 AS (SELECT doc_key AS doc_id, {sentences_sql('text')} AS l FROM documents),
s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM s0),
w AS (SELECT doc_id, pos, unnest({terms_sql('sentence')}) AS t FROM s),
b AS (SELECT doc_id, pos, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {CFG.embed_dim} AS k, count(*) AS c FROM w GROUP BY ALL),
nrm AS (SELECT doc_id, pos, sqrt(CAST(sum(c * c) AS DOUBLE)) AS n FROM b GROUP BY ALL),
dot AS (SELECT x.doc_id, x.pos, CAST(sum(x.c * y.c) AS DOUBLE) AS d FROM b x JOIN b y ON x.doc_id = y.doc_id AND y.pos = x.pos - 1 AND x.k = y.k GROUP BY ALL),
sim AS (SELECT s.doc_id, s.pos, s.sentence, greatest(1, length(s.sentence) // 4) AS tokens,
        coalesce(d, 0) / (coalesce(p.n, 0) * coalesce(q.n, 0) + 1e-8) AS similarity
        FROM s LEFT JOIN dot USING (doc_id, pos) LEFT JOIN nrm p USING (doc_id, pos) LEFT JOIN nrm q ON q.doc_id = s.doc_id AND q.pos = s.pos - 1),
fold AS (SELECT doc_id, pos, tokens AS running, true AS starts FROM sim WHERE pos = 0
         UNION ALL SELECT sim.doc_id, sim.pos, CASE WHEN similarity < {CFG.semantic_similarity_threshold} OR running + tokens > {CFG.chunk_size_tokens} THEN tokens ELSE running + tokens END,
                similarity < {CFG.semantic_similarity_threshold} OR running + tokens > {CFG.chunk_size_tokens}
         FROM fold JOIN sim ON sim.doc_id = fold.doc_id AND sim.pos = fold.pos + 1)"""
_CHUNK = _SIM + """,
num AS (SELECT sim.doc_id, sim.pos, sim.sentence, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY sim.doc_id ORDER BY sim.pos) - 1 AS k FROM sim JOIN fold USING (doc_id, pos)),
c AS (SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, string_agg(sentence, ' ' ORDER BY pos) AS text, arg_min(sentence, pos) AS first FROM num GROUP BY doc_id, k)"""
_BACK, _HALF = CFG.chunk_overlap_tokens * 4, CFG.parent_chunk_size_tokens * 2
_OFFSET = _CHUNK + f""",
d AS (SELECT doc_key AS doc_id, text AS whole FROM documents),
m AS (SELECT doc_id, max(chunk_index) AS last FROM c GROUP BY doc_id),
o AS (SELECT c.doc_id, chunk_index, strpos(whole, first) - 1 AS found, length(c.text) AS n FROM c JOIN d USING (doc_id) WHERE chunk_index = 0
      UNION ALL SELECT c.doc_id, c.chunk_index,
             CASE WHEN strpos(substr(whole, greatest(0, o.found + o.n - {_BACK}) + 1), first) = 0 THEN -1
                  ELSE strpos(substr(whole, greatest(0, o.found + o.n - {_BACK}) + 1), first) - 1 + greatest(0, o.found + o.n - {_BACK}) END, length(c.text)
      FROM o JOIN c ON c.doc_id = o.doc_id AND c.chunk_index = o.chunk_index + 1 JOIN d ON d.doc_id = c.doc_id),
off AS (SELECT o.doc_id, chunk_index, CAST(greatest(0, found) AS BIGINT) AS start_char,
        CAST(CASE WHEN chunk_index = last THEN least(found + n, length(whole)) ELSE found + n END AS BIGINT) AS end_char, whole FROM o JOIN m USING (doc_id) JOIN d USING (doc_id))"""
ORACLE = {
    "adjacent_cosine": _SIM + " SELECT doc_id, pos, round(similarity, 9) AS similarity FROM sim WHERE pos > 0",
    "chunk_boundaries": _SIM + " SELECT doc_id, pos, sim.tokens FROM fold JOIN sim USING (doc_id, pos) WHERE starts",
    "chunks": _CHUNK + " SELECT substr(sha256(c.doc_id || ':' || chunk_index), 1, 16) AS chunk_id, c.doc_id, chunk_index, c.text, doc_type FROM c JOIN documents ON doc_key = c.doc_id",
    "chunk_offsets": _OFFSET + " SELECT doc_id, chunk_index, start_char, end_char FROM off",
    "chunks_per_doc": _CHUNK + " SELECT doc_id, count(*) AS n_chunks FROM c GROUP BY doc_id",
    "parent_windows": _OFFSET + rf""",
p AS (SELECT doc_id, chunk_index, whole, greatest(0, least(start_char - {_HALF}, length(whole) - 1)) AS l, least(length(whole), greatest(0, end_char + {_HALF})) AS r FROM off),
q AS (SELECT doc_id, chunk_index, whole, CASE WHEN l > 0 THEN length(regexp_extract(substr(whole, 2, l), '(?s)^.*[.!?\n]')) ELSE 0 END AS lm, r,
      length(regexp_extract(substr(whole, r + 1), '(?s)^[^.!?\n]*[.!?\n]')) AS rm FROM p)
SELECT substr(sha256(doc_id || ':' || chunk_index), 1, 16) AS chunk_id,
       regexp_replace(substr(whole, CASE WHEN lm > 0 THEN lm + 1 ELSE 0 END + 1, (CASE WHEN rm > 0 THEN r + rm ELSE length(whole) END) - (CASE WHEN lm > 0 THEN lm + 1 ELSE 0 END)), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS parent_text FROM q""",
}
