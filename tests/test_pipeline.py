"""Stores, loaded indexes, recovery after failures, and the plug-ins of answers and evaluation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexlode import schemas
from lexlode.config import Settings
from lexlode.operators import answering as A
from lexlode.operators import graph as G
from lexlode.operators import ingest as I
from lexlode.operators import models as M
from lexlode.operators import orchestrate as O
from lexlode.operators import reporting as R
from lexlode.sources.files import save_uploads
from lexlode.sources.store import append_new, read_table

NAMES = ["Ann Lee", "Bob Ray", "Cleo Institute", "Dora Map", "Emil Sea"]


def _docs(spark, n, start=0):
    text = lambda i: f"{NAMES[i % 5]} met {NAMES[(i + 1) % 5]} near the harbour {i}. The cache keeps row {i} of the table. Nothing else is known."
    return spark.createDataFrame([(f"d{i}", "s", "text", f"Title {i}", text(i), {}) for i in range(start, start + n)], schemas.struct(schemas.DOCUMENT))


def _queries(spark):
    texts = ["compare the cache and the table", "harbour 3", "who met Bob Ray", "nothing of this kind zzz"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_a_failed_store_is_completed(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "store")
    real = I.append_new

    def broken(rows, path, *args, **kw):
        if path.endswith("/vectors"):
            raise OSError("disk is full")
        return real(rows, path, *args, **kw)

    monkeypatch.setattr(I, "append_new", broken)
    first = I.ingest(_docs(spark, 6), base)
    assert first.chunks_stored == 0 and first.bm25_indexed > 0 and first.errors == [("vectors", "disk is full")]
    assert I.health(spark, base)["status"] == "degraded"
    monkeypatch.setattr(I, "append_new", real)
    again = I.ingest(_docs(spark, 6), base)
    assert (again.documents_processed, again.chunks_stored, again.bm25_indexed, again.graph_entities, again.errors) == (6, first.chunks_created, 0, 0, [])
    assert I.ingest(_docs(spark, 6), base).documents_processed == 0 and I.health(spark, base)["status"] == "ok"
    third = I.ingest(_docs(spark, 3, 6), base)
    assert third.documents_processed == 3 and third.graph_triples > 0
    assert read_table(spark, f"{base}/vectors", schemas.STORED_VECTOR).groupBy("chunk_id").count().where("count > 1").count() == 0


def test_read_errors_are_no_empty_tables(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        append_new(spark.createDataFrame([("a", 1)], schemas.struct(schemas.CHUNK_LENGTH)), str(tmp_path / "bad"), schemas.CHUNK_LENGTH, ["chunk_id"])
    assert read_table(spark, str(tmp_path / "none"), schemas.CHUNK_LENGTH).count() == 0
    assert append_new(spark.createDataFrame([("a", 1), ("a", 1)], schemas.struct(schemas.CHUNK_LENGTH)), str(tmp_path / "t"), schemas.CHUNK_LENGTH, ["chunk_id"]) == 1
    assert append_new(spark.createDataFrame([], schemas.struct(schemas.CHUNK_LENGTH)), str(tmp_path / "t"), schemas.CHUNK_LENGTH, ["chunk_id"]) == 0


def test_loaded_indexes_answer_like_built_ones(spark, tmp_path):
    base, cfg = str(tmp_path / "store"), Settings(nprobe=16)
    I.ingest(_docs(spark, 20), base, cfg)
    chunks = read_table(spark, f"{base}/vectors", schemas.STORED_VECTOR).drop("vector", "cell")
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.retriever, round(r.score, 9)) for r in df.collect())
    loaded, counts, failures = O.retrieve_with(_queries(spark), O.Indexes.load(spark, base, cfg), cfg)
    built, _, _ = O.retrieve_with(_queries(spark), O.Indexes.build(chunks, read_table(spark, f"{base}/graph/triples", schemas.TRIPLE), cfg), cfg)
    assert key(loaded) == key(built) and len(key(built)) > 5 and failures == []
    assert {r.retriever for r in counts.collect()} == {"bm25", "dense", "graph"}
    pruned, _, _ = O.retrieve_with(_queries(spark), O.Indexes.load(spark, base, cfg), Settings(nprobe=4))
    assert pruned.count() > 0

    def down(asked):
        raise ConnectionError("the vectors are away")

    rest, counts, failures = O.retrieve_with(_queries(spark), O.Indexes.load(spark, base, cfg), cfg, {"dense": down})
    assert failures == [("dense", "the vectors are away")] and {r.retriever for r in counts.collect()} == {"bm25", "graph"} and rest.count() > 0
    empty = O.Indexes.load(spark, str(tmp_path / "empty"), cfg)
    assert O.retrieve_with(_queries(spark), empty, cfg)[0].count() == 0


def test_extractors(spark):
    chunks = spark.createDataFrame([("c1", "s", "Ann Lee employer Cleo Institute. Bob Ray saw it."), ("c2", "s", "nothing"), ("c3", "s", None)], "chunk_id string, source string, text string")
    got = {(r.subject, r.predicate, r.object, r.extractor) for r in I.extract(chunks, "rule").collect()}
    assert got == {("Ann Lee", "employer", "Cleo Institute", "rule")}
    load = lambda: lambda rows: ["<triplet> ann <subj> bob <obj> author" if t else None for (t,) in rows]
    assert {(r.chunk_id, r.subject, r.predicate) for r in I.extract(chunks, "rebel", generate=load).collect()} == {("c1", "Ann", "author"), ("c2", "Ann", "author")}
    js = lambda: lambda rows: ['[{"subject": "a", "predicate": "b", "object": "c"}]' for _ in rows]
    assert I.extract(chunks, "llm-filtered", Settings(density_min_entities=1), js).count() == 1
    with pytest.raises(ValueError):
        I.extract(chunks, "llm")
    assert "rule" in Settings().graph_extractor


def test_densest_chunks_against_brute_force(spark):
    r = random.Random(4)
    rows = [(f"{r.randrange(16**6):06x}", "s", " ".join(["Ann Lee,"] * r.randrange(1, 5) + ["word"] * r.randrange(1, 4))) for _ in range(300)]
    df = spark.createDataFrame(rows, "chunk_id string, source string, text string").dropDuplicates(["chunk_id"])
    for share in (0.0, 0.3, 0.77, 1.0):
        cfg = Settings(density_top_fraction=share)
        d = [x for x in G.density(df, cfg).collect() if x.n_entities >= cfg.density_min_entities]
        want = {x.chunk_id for x in sorted(d, key=lambda x: (-round(x.density, 9), x.chunk_id))[: max(1, int(len(d) * share))]}
        assert {x.chunk_id for x in G.dense_chunks(df, cfg).collect()} == want
    assert G.dense_chunks(df.limit(0)).count() == 0
    long = spark.createDataFrame([("c", "s", "word " * 4000 + "Ann Lee")], "chunk_id string, source string, text string")
    assert G.chunk_entities(long).count() == 1 and G.chunk_entities(long, Settings(ner_chars=100)).count() == 0


def test_anchors_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abC") for _ in range(r.randrange(1, 6)))
    labels, ents = sorted({word() for _ in range(60)}), [(i % 7, i, word()) for i in range(40)]
    got = G.anchor_nodes(spark.createDataFrame(ents, "query_id int, pos int, entity string"), spark.createDataFrame([(x,) for x in labels], "label string"), 1000)
    want = {}
    exact = {(q, e) for q, _, e in ents for x in labels if x.lower() == e.lower()}
    for q, pos, e in ents:
        for x in labels:
            a, b = e.lower(), x.lower()
            late = 0 if a == b else 1 if (a in b or b in a) and (q, e) not in exact else None
            if late is not None:
                want[(q, x)] = min(want.get((q, x), (99, 9)), (pos, late))
    assert {(x.query_id, x.label) for x in got.collect()} == set(want)


def test_graph_search_prunes_nothing_that_counts(spark):
    r = random.Random(2)
    nodes = [f"n{i}" for i in range(12)]
    edges = sorted({tuple(sorted(r.sample(nodes, 2))) for _ in range(14)})
    e = spark.createDataFrame([(a, b, f"c{r.randrange(40)}") for a, b in edges], "node_a string, node_b string, chunk_id string")
    of_nodes = spark.createDataFrame(sorted({(n, f"c{r.randrange(40)}") for n in nodes for _ in range(r.randrange(6))}), "label string, chunk_id string")
    reached = G.hops(spark.createDataFrame([(1, "n0"), (2, "n7")], "query_id int, label string"), e)
    every = G.graph_search(reached, e, of_nodes, e, 10_000).collect()
    for k in (1, 2, 3, 5):
        assert {(x.query_id, x.chunk_id, x.rank) for x in G.graph_search(reached, e, of_nodes, e, k).collect()} == {(x.query_id, x.chunk_id, x.rank) for x in every if x.rank <= k}


def test_sources_and_answers(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, query string")
    res = lambda ids: lambda asked: asked.where(F.col("query_id").isin(ids)).select("query_id", F.lit(0).alias("pos"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit("text").alias("content"))

    def down(asked):
        raise OSError

    assert {r.query_id: r.source for r in A.first_source(q, [("x", down), ("y", res([1])), ("z", res([1, 2]))]).collect()} == {1: "y", 2: "z"}
    assert A.first_source(q, [("x", down)]).count() == 0
    ranked = spark.createDataFrame([(1, "c1", "T", "s", "First. Second.", "", 0.5, 1)], "query_id int, chunk_id string, title string, source string, text string, parent_text string, score double, rank int")
    load = lambda: lambda rows: [f"made of {len(p)} [1]" if "Question" in p else None for (p,) in rows]
    got = {r.query_id: r.answer for r in A.generated_answer(ranked, q, load).collect()}
    assert got[1].startswith("made of") and got[2] == A.EMPTY_ANSWER
    assert {r.query_id: r.answer for r in A.generated_answer(ranked, q, lambda: lambda rows: [None for _ in rows]).collect()}[1] == "First. [1]"
    gate = spark.createDataFrame([(1, "GOOD", None, False)], "query_id int, grade string, rewritten_query string, web_search_used boolean")
    out = {r.query_id: json.loads(r.response) for r in A.json_response(q, ranked, gate, A.extractive_answer(ranked, q)).collect()}
    assert out[1]["sources"][0]["chunk_id"] == "c1" and out[1]["grade"] == "GOOD" and out[2]["sources"] == [] and out[2]["grade"] is None
    shown = {r.id: r.available for r in A.providers(spark).collect()}
    assert shown["offline"] and not shown["custom"] and {r.id: r.available for r in A.providers(spark, {"custom": "k"}).collect()}["custom"]


def test_cache_and_evaluation(spark, tmp_path):
    q = spark.createDataFrame([(1, " Q "), (2, "q"), (3, "other")], "query_id int, query string")
    asked = []

    def live(missed):
        asked.append(sorted(r.query for r in missed.collect()))
        return missed.select("query_id", F.when(F.col("query") == "other", "[]").otherwise('{"n": 1}').alias("payload"))

    base = str(tmp_path)
    first, fresh = R.cached_answers(q, R.stored_cache(spark, base), 100.0, live)
    assert asked == [[" Q ", "other"]] and {r.query_id: (r.hit, r.payload) for r in first.collect()} == {1: (False, '{"n": 1}'), 2: (False, '{"n": 1}'), 3: (False, "[]")}
    R.store_cache(fresh, base)
    again, _ = R.cached_answers(q, R.stored_cache(spark, base), 200.0, live)
    assert {r.query_id: r.hit for r in again.collect()} == {1: True, 2: True, 3: False}
    late, _ = R.cached_answers(q, R.stored_cache(spark, base), 100.0 + Settings().cache_ttl_seconds, live)
    assert not any(r.hit for r in late.collect())

    chunks = spark.createDataFrame([("c1", "the rail map"), ("c1", "the rail map")], "chunk_id string, text string")
    pairs = spark.createDataFrame([(1, 10, "rail", "Rail map. [1]", ["c1"]), (2, 10, "rail", "again", ["c1"]), (3, 11, "x", None, []), (4, 12, "sea", "No.", [])], "pair_id long, query_log_id long, query string, answer string, chunk_ids array<string>")
    metrics = spark.createDataFrame([], schemas.struct(schemas.EVAL_METRIC))
    scores = spark.createDataFrame([(10, 0.5)], "query_log_id long, mean_chunk_score double")
    rows = {r.query_log_id: r for r in M.evaluate(pairs, chunks, scores, metrics, 5.0).collect()}
    assert set(rows) == {10, 12} and (rows[10].context_utilisation, rows[10].context_precision, rows[10].mean_chunk_score, rows[10].timestamp) == (1.0, 1.0, 0.5, 5.0)
    assert rows[12].context_precision is None and rows[12].context_utilisation == 0
    assert M.evaluate(pairs, chunks, scores, spark.createDataFrame([(1, 10)], "id long, query_log_id long"), 5.0).count() == 1
    assert M.evaluate(pairs, chunks, scores, metrics, 5.0, Settings(eval_enabled=False)).count() == 0
    load = lambda: lambda rows: ["rail\nsea" if "map" in a else None for (a,) in rows]
    by = {r.pair_id: r.answer_relevancy for r in M.answer_relevancy_by_questions(pairs.where("pair_id in (1, 4)"), load).collect()}
    assert by[1] == pytest.approx(0.5) and by[4] == 0


def test_uploads_on_the_sessions_file_system(spark, tmp_path):
    saved, refused = save_uploads([("../a.txt", b"one"), ("b.exe", b"no")], f"file://{tmp_path}/up", spark)
    assert saved == [f"file://{tmp_path}/up/a.txt"] and (tmp_path / "up/a.txt").read_bytes() == b"one" and refused[0][0] == "b.exe"


def test_a_failed_retriever_is_no_result(spark, monkeypatch):
    from lexlode.operators import vectors
    from lexlode.operators.chunking import chunk_documents

    def down(*a):
        raise ConnectionError("the vectors are away")

    monkeypatch.setattr(vectors, "dense_search", down)
    with pytest.raises(RuntimeError, match="dense: the vectors are away"):
        O.retrieve(_queries(spark), chunk_documents(_docs(spark, 3)), None)


def test_texts_of_candidates_alone_are_shuffled(spark, monkeypatch):
    """Only candidates' texts leave the scan, and no text is carried on to the shuffle by query; either way of filtering gives the same rows."""
    import itertools
    import re

    from lexlode.operators.chunking import chunk_documents

    index = O.Indexes.build(chunk_documents(_docs(spark, 20)), None)
    final, _, _ = O.retrieve_with(_queries(spark), index)
    few = final.select("query_id", "rank", "chunk_id", "score")
    lines = few._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(re.match(r"[\s:+|-]*", x)[0])
    by_query = [i for i, x in enumerate(lines) if re.search(r"Join Inner, \(query_id", x)]
    for i in by_query:
        below = itertools.takewhile(lambda x: depth(x) > depth(lines[i]), lines[i + 1 :])
        assert not any("parent_text" in x for x in below)
    assert by_query and any("Join LeftSemi, (chunk_id" in x for x in lines)
    monkeypatch.setattr(O, "FEW_CHUNKS", 0)
    joined, _, _ = O.retrieve_with(_queries(spark), index)
    assert few.count() > 3 and sorted(map(tuple, joined.select(*few.columns).collect())) == sorted(map(tuple, few.collect()))
    assert set(joined.columns) == set(final.columns) and joined.where("text is null").count() == 0


def test_windows_are_written_where_they_are_made(spark, tmp_path, monkeypatch):
    """No join, sort or shuffle moves the windows; stores hold what the chunks say, and a store that has a part of them gets the rest."""
    import re

    from lexlode.operators import lexical
    from lexlode.operators.chunking import chunk_documents

    base, other, plans, real = str(tmp_path / "a"), str(tmp_path / "b"), {}, I.append_new

    def seen(rows, path, *args, **kw):
        plans[path] = rows._jdf.queryExecution().optimizedPlan().toString()
        return real(rows, path, *args, **kw)

    monkeypatch.setattr(I, "append_new", seen)
    docs = _docs(spark, 6)
    first = I.ingest(docs, base)
    assert first.errors == [] and not re.search("Join|Aggregate|Sort|Repartition", plans[f"{base}/vectors"])
    chunks = chunk_documents(docs)
    key = lambda df: sorted(map(tuple, df.collect()))
    cols = ["chunk_id", "doc_id", "text", "parent_text", "chunk_index"]
    store = lambda at: read_table(spark, f"{at}/vectors", schemas.STORED_VECTOR)
    assert key(store(base).select(cols)) == key(chunks.select(cols)) and first.chunks_stored > 6
    assert key(read_table(spark, f"{base}/bm25/postings", schemas.POSTING)) == key(lexical.postings(chunks))
    assert key(read_table(spark, f"{base}/bm25/stats", schemas.CHUNK_LENGTH)) == key(lexical.doc_stats(chunks, lexical.postings(chunks)))
    assert key(store(base).select("chunk_id", "vector", "cell")) == key(read_table(spark, f"{base}/vectors_by_cell", "chunk_id string, vector array<float>, cell int"))
    store(base).where("chunk_index = 0 and doc_id <> 'd0'").write.parquet(f"{other}/vectors")
    assert I.ingest(docs, other).chunks_stored == first.chunks_stored - 5 and key(store(other).select(cols)) == key(chunks.select(cols))


def test_a_repeated_query_is_searched_once(spark, monkeypatch):
    """Queries of one text have one row of the dense search, and each of them gets its hits."""
    from lexlode.operators import vectors
    from lexlode.operators.chunking import chunk_documents

    searched, real = [], vectors.dense_search

    def seen(q, *args):
        searched.append(q.count())
        return real(q, *args)

    monkeypatch.setattr(vectors, "dense_search", seen)
    q = spark.createDataFrame([(1, "compare the cache and the table"), (2, "compare the cache and the table"), (3, "compare harbour 3 and harbour 1"), (4, None)], "query_id int, query string")
    index = O.Indexes.build(chunk_documents(_docs(spark, 5)), None)
    final, counts, failures = O.retrieve_with(q, index)
    hits = {(r.query_id, r.retriever): r.hits for r in counts.collect()}
    assert failures == [] and searched == [2] and hits[(1, "dense")] == hits[(2, "dense")] > 0 and hits[(3, "dense")] > 0
    rows = [(r.query_id, r.rank, r.chunk_id) for r in final.collect()]
    assert {x[1:] for x in rows if x[0] == 1} == {x[1:] for x in rows if x[0] == 2} != set()
