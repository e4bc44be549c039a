"""How distinctive each term is for its record: parsimonious language models.

The terms of a record are explained by a mixture of the record's own model and the
background of the whole collection. Expectation maximisation moves the mass of
terms that the background explains out of the record's model; what is left ranks
the terms. Background counts cover all records. From the raw shares the iteration nears
its limit ever more slowly where a term's mass vanishes, so it starts at the point that
the conditions of the limit name, and ends once no probability moves any more. A
record's scores thus depend on its own terms alone.

Terms in more than a 1/``SHARE`` part of all (record, term) pairs number at most
``SHARE``, whatever the collection: they are sent to the workers. All others are
rare by the same bound, so the join that brings their counts has no hot key.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlode.session import cut

SHARE, WEIGHT, ROUNDS, SETTLED = 20_000, 0.1, 50, 1e-12
_NOT_TERM = re.compile(r"[^\w\s\-]")
_TERMS = pa.list_(pa.string())
_COUNTS = pa.list_(pa.int32())


def terms(text: str) -> list[str]:
    """Terms of a text: lower case, other marks than letters, digits, _ and - as spaces, split at white space."""
    return _NOT_TERM.sub(" ", text.lower()).split()


def _count(batches):
    for b in batches:
        names, counts, lengths = [], [], []
        for text in b.column(1).to_pylist():
            got: dict[str, int] = {}
            for t in terms(text):
                got[t] = got.get(t, 0) + 1
            names.append(list(got))
            counts.append(list(got.values()))
            lengths.append(len(text))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int32()), pa.array(names, _TERMS), pa.array(counts, _COUNTS)], names=["id", "n_chars", "terms", "tf"])


def _background(batches):
    """Record and term counts of the batches of a partition, added up before they are shuffled."""
    for b in batches:
        flat = pa.table({"term": pc.list_flatten(b.column(0)), "tf": pc.list_flatten(b.column(1)).cast(pa.int64())})
        g = flat.group_by("term").aggregate([("tf", "sum"), ("tf", "count")])
        yield from pa.table({"term": g["term"], "df": g["tf_count"], "cf": g["tf_sum"]}).to_batches()


def parsimonious(tf: np.ndarray, background: np.ndarray, starts: np.ndarray, weight: float = WEIGHT, rounds: int = ROUNDS) -> np.ndarray:
    """Converged probabilities of terms in the models of their records; ``starts`` marks where records begin.

    Every record has at least one term. In the limit a term that keeps mass has the
    expected share tf / mu - c * background with c = (1 - weight) / weight and one mu for
    the record; terms keep mass in the order of tf / background, down to where it would be negative.
    """
    sizes = np.diff(np.append(starts, len(tf)))
    record = np.repeat(np.arange(len(starts)), sizes)
    c = (1 - weight) / weight
    lead = tf / background
    order = np.lexsort((-lead, record))
    runs = lambda x: (lambda s: s - np.concatenate([[0.0], s])[starts][record])(np.cumsum(x))
    mu = runs(tf[order]) / (1 + c * runs(background[order]))
    keeps = lead[order] > c * mu
    last = np.maximum.reduceat(np.where(keeps, np.arange(len(tf)), starts[record]), starts)
    limit = np.maximum(0.0, tf / mu[last][record] - c * background)
    p = limit / np.add.reduceat(limit, starts)[record]
    for _ in range(rounds):
        e = tf * (weight * p) / ((1 - weight) * background + weight * p)
        new = e / np.maximum(np.add.reduceat(e, starts), 1e-300)[record]
        moved = np.abs(new - p).max()
        p = new
        if moved < SETTLED:
            break
    return p


def _score(hot: dict[str, tuple[int, int]], total: int, min_tf: int, min_df: int, max_df: int | None):
    def run(batches):
        for b in batches:
            tf_lists, term_lists = b.column(3), b.column(2)
            sizes = np.asarray(pc.list_value_length(term_lists).fill_null(0))
            names = pc.list_flatten(term_lists).to_pylist()
            tf = np.asarray(pc.list_flatten(tf_lists)).astype(float)
            df, cf = np.zeros(len(names), dtype=np.int64), np.ones(len(names))
            rare = [dict(zip(r or (), zip(d or (), c or ()))) for r, d, c in zip(*(b.column(k).to_pylist() for k in (4, 5, 6)))]
            i = 0
            for n, own in zip(sizes, rare):
                for j in range(i, i + n):
                    df[j], cf[j] = hot.get(names[j]) or own[names[j]]
                i += n
            some = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[some]
            p = parsimonious(tf, cf / total, starts) if len(tf) else tf
            owner = np.repeat(np.arange(len(sizes)), sizes)
            keep = np.flatnonzero((tf >= min_tf) & (df >= min_df) & ((df <= max_df) if max_df else True))
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([names[k] for k in keep], pa.string()),
                 pa.array(tf[keep].astype(np.int32)), pa.array(df[keep]), pa.array(p[keep])],
                names=["id", "n_chars", "term", "tf", "df", "score"])
    return run


def distinctive_terms(records: DataFrame, id_col: str = "chunk_id", text_col: str = "text", min_tf: int = 1, min_df: int = 1,
                      max_df: int | None = None) -> DataFrame:
    """One row per distinct record and term: id, n_chars of the text, term, tf, df, score.

    ``df`` counts the distinct records that hold the term. The score is the term's
    probability in the record's parsimonious model, high for terms typical of the
    record. ``min_tf``, ``min_df`` and ``max_df`` choose which rows come out; the models are
    always made of all terms and all records. Null ids and texts take no part,
    empty texts have no terms, a record stored twice counts once, other columns are
    not read, an empty table gives an empty result.
    """
    src = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").dropDuplicates(["id"])
    kind = src.schema["id"].dataType.simpleString()
    counted = cut(src.mapInArrow(_count, f"id {kind}, n_chars int, terms array<string>, tf array<int>"), "terms-counted")
    stats = cut(counted.select("terms", "tf").mapInArrow(_background, "term string, df long, cf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), "terms-stats")
    total, pairs = stats.agg(F.sum("cf"), F.sum("df")).first()
    bound = max(1, (pairs or 0) / SHARE)
    hot = {r.term: (r.df, r.cf) for r in stats.where(F.col("df") > bound).collect()}  # at most SHARE rows
    known = F.broadcast(stats.where(F.col("df") > bound).select("term"))  # the same rows: hot terms never reach the shuffle
    rare = (
        counted.select("id", F.explode("terms").alias("term")).join(known, "term", "left_anti")
        .join(stats.where(F.col("df") <= bound), "term").groupBy("id")
        .agg(F.collect_list(F.struct("term", "df", "cf")).alias("own"))
    )
    joined = counted.join(rare, "id", "left").select("id", "n_chars", "terms", "tf", F.col("own.term").alias("rt"), F.col("own.df").alias("rd"), F.col("own.cf").alias("rc"))
    return joined.mapInArrow(_score(hot, total or 1, min_tf, min_df, max_df), f"id {kind}, n_chars int, term string, tf int, df long, score double").withColumnRenamed("id", id_col)
