"""The whole retrieval of a batch of queries as one plan."""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode import schemas
from lexlode.config import Settings
from lexlode.operators import answering, fusion, graph, lexical, vectors
from lexlode.operators.chunking import Embedder, hashing_embedder
from lexlode.session import cut
from lexlode.sources.store import read_table

FEW_CHUNKS = 200_000  # candidates whose ids are sent to every task; more are joined
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def query_text(query: Column | str, cfg: Settings = Settings()) -> Column:
    """A query as it is embedded: models of the bge family want an instruction before it."""
    q = F.col(query) if isinstance(query, str) else query
    return F.concat(F.lit(QUERY_PREFIX), q) if "bge" in cfg.embed_model_name.lower() else q


def embedded(embed: Embedder, texts: list[str], cfg: Settings) -> np.ndarray:
    """Vectors of texts as they are stored, a batch of the model's size at a time."""
    step = max(1, cfg.embed_batch_size)
    return np.vstack([embed(texts[i : i + step]) for i in range(0, len(texts), step)]).astype("float32") if texts else np.empty((0, cfg.embed_dim), dtype="float32")


def embed_column(df: DataFrame, id_col: str, text_col: str, cfg: Settings = Settings(), make=hashing_embedder, prefix: str = "") -> DataFrame:
    """Vectors of texts: id, embedding. The embedder is made once per task and fed whole batches."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        embed: Embedder = make(cfg.embed_dim)
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(embedded(embed, texts, cfg)), pa.list_(pa.float32()))], names=["id", "embedding"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


@dataclass
class Indexes:
    """What the retrievers search: made of chunks and triples, or read from what ingestion stored."""

    chunks: DataFrame
    bm25: lexical.Bm25Index
    vectors: DataFrame
    centroids: np.ndarray | None
    edges: DataFrame | None
    node_chunks: DataFrame | None
    edge_chunks: DataFrame | None

    @classmethod
    def build(cls, chunks: DataFrame, triples: DataFrame | None, cfg: Settings = Settings(), make=hashing_embedder) -> "Indexes":
        once = lexical.distinct_chunks(chunks)
        stored = embed_column(once, "chunk_id", "text", cfg, make).withColumnRenamed("id", "vec_id")
        return cls(once, lexical.Bm25Index(chunks, cfg), stored, None, *cls._graph(triples, graph.chunk_entities(once), cfg))

    @classmethod
    def load(cls, spark: SparkSession, base: str, cfg: Settings = Settings()) -> "Indexes":
        """The stores below ``base``; nothing is chunked, embedded or extracted again."""
        chunks = read_table(spark, os.path.join(base, cfg.vectors_path), schemas.STORED_VECTOR)
        cells = read_table(spark, os.path.join(base, cfg.vectors_path + BY_CELL), schemas.CELL_VECTOR)
        at = os.path.join(base, cfg.graph_path)
        triples = read_table(spark, f"{at}/triples", schemas.TRIPLE)
        centroids = read_table(spark, os.path.join(base, cfg.vectors_path + "_cells"), CENTROID).orderBy("cell").collect()  # at most nlist rows
        return cls(chunks.drop("vector", "cell"), lexical.Bm25Index.load(spark, base, cfg), cells.select(F.col("chunk_id").alias("vec_id"), F.col("vector").alias("embedding"), "cell"),
                   np.array([r.center for r in centroids]) if centroids else None, *cls._graph(triples, read_table(spark, f"{at}/entities", schemas.ENTITY), cfg))

    @staticmethod
    def _graph(triples: DataFrame | None, entities: DataFrame, cfg: Settings) -> tuple:
        if triples is None or not cfg.graph_enabled:
            return None, None, None
        return cut(graph.node_pairs(triples), "retrieve-edges"), graph.node_chunks(entities), graph.edge_chunks(triples)


BY_CELL = "_by_cell"  # what searches read: the vectors alone, one folder per cell
CENTROID = "cell int, center array<double>"
LIST = "query_id {kind}, chunk_id string, score double, retriever string"


def retrieve_with(queries: DataFrame, index: Indexes, cfg: Settings = Settings(), retrievers: dict | None = None, make=hashing_embedder) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """Route, run the chosen retrievers, fuse and rerank: (final chunks, hit counts, failures).

    ``queries``: query_id, query. Each retriever sees only the queries routed to it. One
    that fails is left out, and noted as (retriever, error); the others still answer.
    ``retrievers`` replaces or adds functions of queries that give query_id, chunk_id, score.
    """
    routed = queries.select("query_id", "query", answering.strategies_of(answering.route_by_rule("query")).alias("strategies"))
    k = cfg.retrieval_top_k

    def dense(asked: DataFrame) -> DataFrame:
        asked = asked.where("query_id is not null and query is not null").distinct()
        first = asked.groupBy("query").agg(F.min("query_id").alias("first"))  # queries of one text have the same neighbours: each text is searched once
        texts = first.select(F.col("first").alias("query_id"), query_text("query", cfg).alias("query"))
        q = embed_column(texts, "query_id", "query", cfg, make).withColumnRenamed("id", "query_id")
        if index.centroids is not None and cfg.nprobe < len(index.centroids):
            hits = vectors.ivf_search(q, index.vectors, k, cfg.nlist, cfg.nprobe, index.centroids)
        else:
            hits = vectors.dense_search(q, index.vectors, k)
        found = hits.where("score > 0").select(F.col("query_id").alias("first"), F.col("vec_id").alias("chunk_id"), "score")
        return found.join(asked.join(first, "query").select("query_id", "first"), "first")

    def by_graph(asked: DataFrame) -> DataFrame:
        nodes = index.edges.select(F.explode(F.array("node_a", "node_b")).alias("label")).distinct()
        anchors = cut(graph.anchor_nodes(graph.query_entities(asked), nodes), "retrieve-anchors")
        return graph.search_from(anchors, index.edges, index.node_chunks, index.edge_chunks, k, cfg.graph_max_hops)

    known = {"bm25": lambda asked: index.bm25.search(asked, k), "dense": dense} | ({"graph": by_graph} if index.edges is not None else {}) | (retrievers or {})
    kind = queries.schema["query_id"].dataType.simpleString()
    every, failures = queries.sparkSession.createDataFrame([], LIST.format(kind=kind)), []
    for name, run in known.items():
        try:
            asked = routed.where(F.array_contains("strategies", name)).select("query_id", "query")
            every = every.unionByName(cut(run(asked).select("query_id", "chunk_id", "score", F.lit(name).alias("retriever")), f"retrieve-{name}"))
        except Exception as e:  # the other retrievers must still answer
            failures.append((name, str(e)[:500]))
    counts = every.groupBy("query_id", "retriever").agg(F.count("*").alias("hits"))
    fused = cut(fusion.rrf_fuse(every, cfg.rrf_k, k), "retrieve-fused")
    return fusion.rerank(_with_texts(fused.join(queries, "query_id"), index.chunks), cfg.final_top_k), counts, failures


def _with_texts(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with the texts of their chunks.

    Only chunks that are candidates of some query are shuffled (up to FEW_CHUNKS ids of them are sent to
    the scan), and the texts come last, so that what needs no text does not carry it any farther.
    """
    texts = chunks.select("chunk_id", "source", "title", "text", "parent_text", "chunk_index")
    ids = cut(asked.select("chunk_id").distinct(), "retrieve-ids")
    if ids.count() <= FEW_CHUNKS:
        texts = texts.join(F.broadcast(ids), "chunk_id", "left_semi")
    return asked.join(texts, "chunk_id")


def retrieve(queries: DataFrame, chunks: DataFrame, triples: DataFrame | None, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Retrieval over chunks and triples that are in no store: the indexes are made for this batch.

    A retriever that fails is an error here: without the list of failures its missing hits would look like none found.
    """
    return complete(*retrieve_with(queries, Indexes.build(chunks, triples, cfg), cfg))


def complete(final: DataFrame, counts: DataFrame, failures: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """The result of ``retrieve_with`` if no retriever failed, else an error that names those that did."""
    if failures:
        raise RuntimeError("retrievers failed: " + "; ".join(f"{name}: {error}" for name, error in failures))
    return final, counts
