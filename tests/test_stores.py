import pytest
from pyspark.sql import functions as F

from lexlode import schemas
from lexlode.__main__ import main
from lexlode.config import Settings
from lexlode.operators import reporting as R
from lexlode.operators.ingest import Stats, health, ingest
from lexlode.sources.files import load_files, safe_name, save_uploads, scan
from lexlode.sources.markup import main_text
from lexlode.sources.store import append_log, append_new, log_queries, read_table
from lexlode.streaming.streams import hourly_counts, ingest_stream, once_per_key, read_stream


def test_settings(spark):
    assert Settings.from_env({"NLIST": "7", "CRAG_ENABLED": "false", "BM25_K1": "2.5", "OTHER": "x"}) == Settings(nlist=7, crag_enabled=False, bm25_k1=2.5)
    assert schemas.struct(schemas.CHUNK).fieldNames()[0] == "chunk_id"


def test_markup():
    assert main_text("<title> T </title><nav>n</nav><article>a<p> b </p><script>x</script></article><main>m<aside>z</aside></main>") == ("m", "T")
    assert main_text("<article>a</article><p>c") == ("a", "") and main_text("plain <b>x</b>") == ("plain\nx", "")


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "my_note.TXT").write_bytes("caf\xe9\n\n\n\nend".encode("latin1"))
    (root / "sub/page.html").write_text("<title>Page</title><main>Body</main>")
    (root / "doc.pdf").write_bytes(b"%PDF")
    (root / "x.exe").write_bytes(b"no")
    docs, errors = load_files(scan(spark, str(root)))
    got = {r.doc_type: (r.title, r.text) for r in docs.collect()}
    assert got == {"text": ("My Note", "caf�\n\nend"), "html": ("Page", "Body")}
    assert [r.error for r in errors.collect()] == ["no PDF reader is installed; pass one as pdf_reader"]
    docs, errors = load_files(scan(spark, str(root), recursive=False), lambda b: ["one", "", "two"])
    assert {r.doc_type: r.text for r in docs.collect()}["pdf"] == "one\n\ntwo" and docs.count() == 2 and errors.count() == 0
    with pytest.raises(FileNotFoundError):
        scan(spark, str(root / "gone"))
    assert safe_name("../../etc/.x.md") == "x.md" and safe_name("a\\b.txt") == "b.txt"
    saved, bad = save_uploads([("../a.txt", b"1"), ("a.txt", b"2"), ("b.exe", b"3")], str(tmp_path / "up"))
    assert len(saved) == 1 and bad == [("b.exe", "unsupported file type")]
    assert main([str(root / "gone")]) == 1


def _docs(spark, n=3):
    rows = [(f"d{i}", "s", "text", "T", f"Ann Lee met Bob Ray in {i}. The map is here.", {"k": "v"}) for i in range(n)]
    return spark.createDataFrame(rows, schemas.struct(schemas.DOCUMENT))


def test_ingest_twice(spark, tmp_path):
    base = str(tmp_path / "store")
    docs = _docs(spark).unionByName(_docs(spark, 1))
    triples = spark.createDataFrame([("ann", "author", "bob", None, "s", "e")], schemas.struct(schemas.TRIPLE))
    first = ingest(docs, base, triples=triples)
    assert (first.documents_processed, first.documents_skipped, first.errors) == (3, 0, [])
    assert first.chunks_created == first.chunks_stored == first.bm25_indexed > 0 and first.graph_entities > 0
    again = ingest(docs, base)
    assert (again.documents_processed, again.documents_skipped, again.chunks_stored, again.bm25_indexed, again.graph_entities) == (0, 3, 0, 0, 0)
    assert health(spark, base)["status"] == "ok" and health(spark, base)["vectors"] == first.chunks_stored
    v = read_table(spark, f"{base}/vectors", schemas.STORED_CHUNK).first()
    assert len(v.vector) == Settings().embed_dim
    assert first.merge(again).documents_skipped == 3 and Stats(errors=[("a", "b")]).row(spark).first().errors[0].error == "b"
    off = ingest(_docs(spark, 5), base, Settings(graph_enabled=False))
    assert off.documents_processed == 2 and off.graph_entities == 0


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    row = [(None, 5.0, "q", None, "[]", "{}", "GOOD", 0, 0, 1, 0.5, 10.0, "m", None)]
    df = spark.createDataFrame(row, schemas.struct(schemas.QUERY_LOG))
    append_log(df, path, schemas.QUERY_LOG, ["timestamp", "query"])
    append_log(df, path, schemas.QUERY_LOG, ["timestamp", "query"])
    rows = read_table(spark, path, schemas.QUERY_LOG)
    assert rows.count() == 2 and R.delivered_once(rows).count() == 1 and rows.first().id >= 0
    assert append_new(df.withColumn("id", F.lit(1)), str(tmp_path / "n"), schemas.QUERY_LOG, ["id"]) == 1
    assert read_table(spark, str(tmp_path / "none"), schemas.CACHE).count() == 0


def test_log_rows(spark, tmp_path):
    answered = spark.createDataFrame([("q", "comparison", ["dense"], {"dense": 3}, "GOOD", None, None, 3, 0.5, 12.0)],
                                     "query string, intent string, strategies array<string>, retriever_hits map<string,int>, crag_grade string, rewritten_query string, web_search_used boolean, num_chunks long, top_chunk_score double, latency_ms double")
    rows = R.log_rows(answered, 5.0, "m")
    log_queries(rows, str(tmp_path))
    got = read_table(spark, str(tmp_path / "logs/queries"), schemas.QUERY_LOG).first()
    assert (got.strategies, got.retriever_hits, got.crag_rewritten, got.web_search_used, got.model) == ('["dense"]', '{"dense":3}', 0, 0, "m")
    assert R.log_rows(answered, 5.0, "m", streamed=True).count() == 0
    assert R.log_rows(answered, 5.0, "m", streamed=True, cfg=Settings(log_streamed=True)).count() == 1
    assert R.unevaluated(rows, spark.createDataFrame([], schemas.struct(schemas.EVAL_METRIC)), Settings(eval_enabled=False)).count() == 0
    plain, wide = (R.cache_table(rows, c).first().key for c in (Settings(), Settings(cache_key_has_candidates=True)))
    assert plain != wide


def test_reports_on_empty_and_edges(spark):
    logs = spark.createDataFrame([], schemas.struct(schemas.QUERY_LOG))
    metrics = spark.createDataFrame([], schemas.struct(schemas.EVAL_METRIC))
    s = R.summary(logs, metrics).first()
    assert (s.total_queries, s.avg_latency_ms, s.avg_faithfulness) == (0, 0.0, 0.0)
    assert {r.crag_grade: r.percent for r in R.grade_mix(logs).collect()} == {"GOOD": 0, "POOR": 0, "ABSENT": 0}
    assert R.recent(logs, metrics, 5).count() == 0 and R.timeseries(logs, metrics, 1e6, 1).count() == 0
    assert R.cache_totals(R.cache_replay(logs)).first().hit_rate == 0.0
    log = lambda i, t, n=1, lat=1.0: (i, float(t), " Q " if i % 2 else "q", None, '["a"]', "{}", "", 0, 0, n, 0.5, lat, None, None)
    logs = spark.createDataFrame([log(1, 0), log(2, 10), log(3, 3609.5), log(4, 3605 + 7000), log(5, 20000, 0), log(6, 20010, 1, -1.0)], schemas.struct(schemas.QUERY_LOG))
    hits = {r.id: r.hit for r in R.cache_replay(logs).collect()}
    assert hits == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    metrics = spark.createDataFrame([(1, 2, 0.0, 0.0005, None, None, 1.0, None), (2, 2, 0.0, 1.0, None, None, None, None)], schemas.struct(schemas.EVAL_METRIC))
    assert [(r.id, r.metric_id) for r in R.recent(logs, metrics, 9).collect() if r.id <= 2] == [(2, 1), (2, 2), (1, None)]
    assert [r.hour_bucket for r in R.timeseries(logs, metrics, 86400 + 5.0, 1).collect()] == [0]
    assert R.timeseries(logs, metrics, 86400 + 10.0, 1).count() == 0
    cache = R.cache_table(logs)
    q = spark.createDataFrame([(1, "Q"), (2, "other")], "query_id long, query string")
    assert {r.query_id: r.payload is not None for r in R.cache_lookup(q, cache, 20020.0).collect()} == {1: True, 2: False}
    assert R.cache_lookup(q, cache, 20010.0 + 3600).where("payload is not null").count() == 0
    assert R.cache_without(cache, cache).count() == 0 and R.cache_without(cache).count() == 0


def test_streams(spark, tmp_path):
    src = str(tmp_path / "docs")
    _docs(spark, 2).write.parquet(src)
    schema = schemas.struct(schemas.DOCUMENT)
    q = ingest_stream(read_stream(spark, src, schema), str(tmp_path / "store"), str(tmp_path / "cp"))
    q.awaitTermination()
    _docs(spark, 3).write.mode("append").parquet(src)
    q = ingest_stream(read_stream(spark, src, schema), str(tmp_path / "store"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert read_table(spark, str(tmp_path / "store/documents"), "doc_id string, source string").count() == 3
    ev = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 1.0d as value, 7 as id union all select timestamp'2024-01-01 00:50:00', 'a', 2.0d, 7 union all select timestamp'2024-01-01 01:00:00', 'a', 4.0d, 8")
    ev.write.parquet(str(tmp_path / "ev"))
    assert sorted((r.hour.hour, r.n, r.total) for r in hourly_counts(ev).collect()) == [(0, 2, 3.0), (1, 1, 4.0)]
    s = once_per_key(read_stream(spark, str(tmp_path / "ev"), ev.schema), "id")
    q = s.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
