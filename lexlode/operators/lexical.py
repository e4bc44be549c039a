"""BM25 index and search over chunks, as tables and joins."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import STOP_WORDS, index_terms, words
from lexlode.schemas import CHUNK_LENGTH, POSTING
from lexlode.session import cut
from lexlode.sources.store import read_table


ASKED, CELLS = 500_000, 8_000_000


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id; a chunk stored twice counts once."""
    return chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"])


def _terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per term of a text. Stop words are dropped after the explode, where a hash set is asked inside generated code."""
    return texts.select(key, F.explode(words(text)).alias("term")).where((F.length("term") > 1) & ~F.col("term").isin(*STOP_WORDS))


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf. Grouping by chunk reuses the partitioning that made the chunks distinct."""
    each = _terms(distinct_chunks(chunks.select("chunk_id", "text")), "chunk_id", "text")
    return each.groupBy("chunk_id", "term").agg(F.count("*").alias("tf")).select("term", "chunk_id", "tf")


def postings_in_place(chunks: DataFrame) -> DataFrame:
    """The postings of chunks that are known to be distinct: each chunk's terms are counted where it is read, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        stop = pa.array(STOP_WORDS)
        for b in batches:
            at, term = pc.list_parent_indices(b.column("terms")), b.column("terms").flatten()
            kept = pc.and_(pc.greater(pc.utf8_length(term), 1), pc.invert(pc.is_in(term, value_set=stop)))
            each = pa.table({"at": at.filter(kept), "term": term.filter(kept)}).group_by(["at", "term"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            for x in each.to_batches():
                yield pa.RecordBatch.from_arrays([x.column("term"), b.column("chunk_id").take(x.column("at")), x.column("count_all")], names=["term", "chunk_id", "tf"])

    return chunks.where("chunk_id is not null and text is not null").select("chunk_id", words("text").alias("terms")).mapInArrow(run, POSTING)


def lengths_in_place(chunks: DataFrame) -> DataFrame:
    """What ``doc_stats`` gives, of chunks that are known to be distinct, without a shuffle."""
    return chunks.where("chunk_id is not null").select("chunk_id", F.coalesce(F.size(index_terms(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long").alias("dl"))


def new_postings(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Postings of chunks that the index does not hold yet."""
    return postings(chunks.join(stored.select("chunk_id").distinct(), "chunk_id", "left_anti"))


def doc_stats(chunks: DataFrame, post: DataFrame) -> DataFrame:
    """chunk_id and its number of terms, for every chunk, empty ones included."""
    lengths = post.groupBy("chunk_id").agg(F.sum("tf").alias("dl"))
    return chunks.where("chunk_id is not null").select("chunk_id").distinct().join(lengths, "chunk_id", "left").select("chunk_id", F.coalesce("dl", F.lit(0)).alias("dl"))


def term_stats(post: DataFrame, stats: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """term, df, idf. A negative idf is lifted to epsilon times the mean raw idf over all terms."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n = stats.agg(F.count("*").alias("n_docs"))
    raw = df.join(F.broadcast(n)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, cfg.bm25_epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


class Bm25Index:
    """The index as tables: postings, chunk lengths and term statistics, made of chunks or read from a store."""

    def __init__(self, chunks: DataFrame | None = None, cfg: Settings = Settings(), stored: tuple[DataFrame, DataFrame] | None = None):
        self.cfg = cfg
        self.postings, self.stats = stored or (cut(postings(chunks), "bm25-postings"), None)
        if self.stats is None:
            self.stats = cut(doc_stats(chunks, self.postings), "bm25-stats")
        self.terms = cut(term_stats(self.postings, self.stats, cfg), "bm25-terms")

    @classmethod
    def load(cls, spark: SparkSession, base: str, cfg: Settings = Settings()) -> "Bm25Index":
        """The index that ingestion keeps below ``base``; nothing is tokenised again."""
        at = os.path.join(base, cfg.bm25_path)
        return cls(cfg=cfg, stored=(read_table(spark, f"{at}/postings", POSTING), read_table(spark, f"{at}/stats", CHUNK_LENGTH)))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Best ``k`` chunks of every query: query_id, chunk_id, raw, score, rank.

        ``queries``: query_id, query. A repeated query term counts repeatedly; chunks
        without a positive score drop out; scores are divided by the query's best.
        The queried terms get their statistics first, so that only their postings are joined.
        """
        asked = _terms(queries, "query_id", "query").groupBy("query_id", "term").agg(F.count("*").alias("qtf")).join(self.terms.select("term", "idf"), "term")
        asked = asked.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        scored = self._in_blocks(asked, k)
        return top_k(scored, "raw", k).withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id")))

    def _in_blocks(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, raw of all positive scores, or of at least the best k of each block of chunks.

        Up to ASKED weights of query terms are sent to the postings: only postings of queried terms are
        shuffled, by chunk, and queries are scored against blocks of chunks, each of which returns
        its own best. More weights than that meet the postings in joins.
        """
        qk = asked.schema["query_id"].dataType.simpleString()
        avg = self.stats.agg(F.avg("dl").alias("avgdl"))
        f, k1, b = F.col("tf"), self.cfg.bm25_k1, self.cfg.bm25_b
        gain = f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        some = asked.limit(ASKED + 1).toArrow()
        if some.num_rows == 0:
            return asked.sparkSession.createDataFrame([], f"query_id {qk}, chunk_id string, raw double")
        if some.num_rows > ASKED:
            hits = self.postings.join(asked, "term").join(self.stats, "chunk_id").join(F.broadcast(avg))
            return hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * gain).alias("raw")).where("raw > 0")
        terms = asked.sparkSession.createDataFrame(pa.table({"term": some["term"].unique()}))
        hits = self.postings.join(F.broadcast(terms), "term", "left_semi").join(self.stats, "chunk_id").join(F.broadcast(avg))
        rows = hits.select("chunk_id", "term", gain.alias("gain")).repartition("chunk_id").sortWithinPartitions("chunk_id")
        return rows.mapInArrow(_score(some.combine_chunks(), k), f"query_id {qk}, chunk_id string, raw double")


def _score(asked: pa.Table, k: int):
    """Best k chunks of each block of chunks for each query, with ties; rows come sorted by chunk."""
    ids, who = _numbered(asked["query_id"])
    names, term = _numbered(asked["term"])
    order = np.argsort(term, kind="stable")
    of_term = dict(zip(names.to_pylist(), zip(np.split(who[order], np.cumsum(np.bincount(term))[:-1]), np.split(np.asarray(asked["weight"])[order], np.cumsum(np.bincount(term))[:-1]))))

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        chunks, at = _numbered(rows["chunk_id"])
        found, mine = _numbered(rows["term"])
        gain = np.asarray(rows["gain"])
        sums = np.zeros((len(ids), len(chunks)))
        first = np.argsort(mine, kind="stable")
        for name, own in zip(found.to_pylist(), np.split(first, np.cumsum(np.bincount(mine))[:-1])):
            queries, weight = of_term[name]
            sums[np.ix_(queries, at[own])] += weight[:, None] * gain[None, own]
        if k and k < len(chunks):
            least = -np.partition(-sums, k - 1, axis=1)[:, k - 1 : k]
            q, c = np.nonzero((sums > 0) & (sums >= least - 1e-8))
        else:
            q, c = np.nonzero(sums > 0)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), chunks.take(pa.array(c)), pa.array(sums[q, c])], names=["query_id", "chunk_id", "raw"])

    most = max(1, CELLS // len(ids))

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            names, at = _numbered(held["chunk_id"])
            while len(names) > most:  # the last chunk may go on in the next batch
                cut_at = int(np.searchsorted(at, most))
                yield from block(held.slice(0, cut_at).combine_chunks())
                held = held.slice(cut_at)
                names, at = _numbered(held["chunk_id"])
        if held is not None and held.num_rows:
            yield from block(held.combine_chunks())

    return run


def _numbered(column) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in the order of their first appearance, and the number of each row's value."""
    coded = column.combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary, np.asarray(coded.indices)


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int, cfg: Settings = Settings()) -> DataFrame:
    """Index the chunks and search them once."""
    return Bm25Index(chunks, cfg).search(queries, k)


def top_k(scored: DataFrame, score: str, k: int | None, group: str | list[str] = "query_id", tie: str = "chunk_id") -> DataFrame:
    """Rows ranked within their group by score (to 9 decimals) and then by the lesser key; all of them without ``k``."""
    order = Window.partitionBy(group).orderBy(F.round(score, 9).desc(), F.col(tie))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k) if k else ranked
