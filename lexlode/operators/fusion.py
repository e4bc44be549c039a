"""Fusing and reranking of retrieved lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlode.functions.text import context_text, index_terms
from lexlode.operators.lexical import top_k


def rank_lists(hits: DataFrame) -> DataFrame:
    """Rank from 1 within each query and retriever, best score first, ties by chunk."""
    w = Window.partitionBy("query_id", "retriever").orderBy(F.round("score", 9).desc(), F.col("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(w))


def rrf_fuse(hits: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: query_id, chunk_id, score, retriever, best_retriever, rank.

    ``hits``: query_id, chunk_id, score, retriever. The score is the sum of 1 / (k + rank)
    over the lists; the retrievers' names are joined by +; the best row is the one
    of the highest score, first names first.
    """
    ranked = rank_lists(hits)
    best = F.max_by(F.col("retriever"), F.struct(F.round("score", 9), -F.ascii("retriever")))
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_list("retriever")), "+").alias("retriever"),
        best.alias("best_retriever"), F.max("score").alias("best_score"))
    return top_k(fused, "score", top)


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """Share of the query's distinct terms that occur in the text: the offline stand-in for a cross-encoder."""
    q = F.array_distinct(index_terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, index_terms(text))) / F.size(q)).otherwise(0.0)


def rerank(candidates: DataFrame, top: int, score=overlap_score) -> DataFrame:
    """Best ``top`` candidates of each query by a scorer over query and context; the scorer's value replaces the score.

    ``candidates``: query_id, query, chunk_id, text, parent_text, score, rank. Ties keep the order of fusion.
    """
    scored = candidates.withColumn("rrf_score", F.col("score")).withColumn("score", score("query", context_text("parent_text", "text")))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("fused_rank"), F.col("chunk_id"))
    return scored.withColumnRenamed("rank", "fused_rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
