import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlode.operators import fusion, lexical, vectors

CHUNKS = [("c1", "rail map rail"), ("c2", "map sea"), ("c3", "map"), ("c4", ""), ("c1", "rail map rail")]


def bm25(query, docs, k1=1.5, b=0.75, eps=0.25):
    docs = {k: t.split() for k, t in docs.items()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else eps * mean for t, v in raw.items()}
    return {k: sum(idf.get(q, 0) * d.count(q) * (k1 + 1) / (d.count(q) + k1 * (1 - b + b * len(d) / avg)) for q in query.split()) for k, d in docs.items()}


def test_bm25(spark):
    c = spark.createDataFrame(CHUNKS, "chunk_id string, text string")
    q = spark.createDataFrame([(1, "rail sea rail"), (2, "unseen"), (3, "the of"), (4, "")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): (r.raw, r.score, r.rank) for r in lexical.bm25_search(q, c, 10).collect()}
    want = {k: v for k, v in bm25("rail sea rail", dict(CHUNKS)).items() if v > 0}
    assert {k[1] for k in got} == set(want) and {k[0] for k in got} == {1}
    for k, v in want.items():
        assert got[(1, k)][0] == pytest.approx(v)
    assert max(s for _, s, _ in got.values()) == 1
    assert lexical.new_postings(c, c.where("chunk_id = 'c1'")).select("chunk_id").distinct().count() == 2


def test_bm25_in_blocks_and_in_joins(spark, monkeypatch):
    """Few weights are sent to blocks of chunks, many meet the postings in joins: the same ranks, ties included."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(f"c{i:03d}", " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(200)], "chunk_id string, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice([*words, "unknown"], rng.integers(0, 4)))) for i in range(40)], "query_id long, query string")
    index = lexical.Bm25Index(chunks)
    got = []
    for asked, cells in ((10**6, 10**6), (10**6, 90), (0, 10**6)):
        monkeypatch.setattr(lexical, "ASKED", asked)
        monkeypatch.setattr(lexical, "CELLS", cells)
        got.append({(r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in index.search(q, 5).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) > 100


def test_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8)).astype("float32")
    rows = [(i, base[i].tolist()) for i in range(300)] + [(900, None)]
    s = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = s.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = {(i, int(j), r + 1) for i in range(7) for r, j in enumerate(np.argsort(-(u[:7] @ u.T)[i], kind="stable")[:5])}
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.dense_search(q, s, 5).collect()} == want
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.dense_search(q, s, 5, block=2).collect()} == want
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.ivf_search(q, s, 5, 6, 6).collect()} == want
    c = vectors.train_centroids(s.where("embedding is not null"), 6)
    path = str(tmp_path / "cells")
    vectors.write_cells(s, c, path)
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.ivf_search(q, spark.read.parquet(path), 5, 6, 6, c, block=3).collect()} == want
    # many queries: vectors in parts, queries streaming past them
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.dense_search(q, s, 5, block=2, few=3, part=40).collect()} == want
    assert {(r.query_id, r.vec_id, r.rank) for r in vectors.ivf_search(q, spark.read.parquet(path), 5, 6, 6, c, block=3, few=2, part=20).collect()} == want
    near = {(r.query_id, r.vec_id, r.rank) for r in vectors.ivf_search(q, s, 5, 6, 2, c).collect()}
    assert near == {(r.query_id, r.vec_id, r.rank) for r in vectors.ivf_search(q, spark.read.parquet(path), 5, 6, 2, c, few=2, part=20).collect()}
    one = vectors.ivf_search(q.where("query_id = 1"), spark.read.parquet(path), 5, 6, 1, c)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(cell" in plan and f"= {int(np.argmax(c @ u[1]))})" in plan
    assert vectors.ivf_search(q, s.limit(0), 5, 6, 2).count() == 0
    some = {(r.query_id, r.vec_id) for r in vectors.ivf_search(q, s, 5, 6, 3).collect()}
    assert len(some & {w[:2] for w in want}) >= 0.7 * len(want)
    assert vectors.dense_search(q.limit(0), s, 5).count() == 0 and vectors.dense_search(q, s.limit(0), 5).count() == 0


def test_rrf(spark):
    rows = [(1, "a", 0.9, "bm25"), (1, "b", 0.9, "bm25"), (1, "a", 0.1, "dense"), (1, "c", 0.2, "dense")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, retriever string")
    got = {r.chunk_id: (r.score, r.retriever, r.rank, r.best_retriever) for r in fusion.rrf_fuse(df).collect()}
    assert got["a"][0] == pytest.approx(1 / 61 + 1 / 62) and got["a"][1:] == ("bm25+dense", 1, "bm25")
    assert got["c"][2] == 2 and got["b"][2] == 3
    assert {r.chunk_id for r in fusion.rrf_fuse(df.orderBy(F.rand(3)), top=1).collect()} == {"a"}


def test_rerank(spark):
    rows = [(1, "rail map", "a", "sea", None, 0.3, 1), (1, "rail map", "b", "x", "the rail map", 0.2, 2), (1, "rail map", "c", "map", "", 0.1, 3)]
    df = spark.createDataFrame(rows, "query_id long, query string, chunk_id string, text string, parent_text string, score double, rank int")
    assert [(r.chunk_id, r.score, r.rank) for r in fusion.rerank(df, 2).orderBy("rank").collect()] == [("b", 1.0, 1), ("c", 0.5, 2)]


def test_ties_of_a_part_are_bounded():
    """A query without terms ties with every vector: only the first ids of equal entries come back, and near ties all do."""
    import numpy as np
    import pyarrow as pa

    from lexlode.operators.vectors import _best, _order

    order = _order(pa.array([f"v{(i * 7) % 1000:04}" for i in range(1000)]))
    who, at = _best(np.zeros((3, 1000)), 5, order)
    assert len(who) == 15 and set(order[at]) == {0, 1, 2, 3, 4}
    sim = np.zeros((1, 1000))
    sim[0, :7] = 0.5 + np.arange(7) * 1e-11
    assert set(_best(sim, 5, order)[1]) == set(range(7))
