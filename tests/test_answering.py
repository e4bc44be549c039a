import pytest
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.operators import answering as A


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("raw, intent, strategies, confidence", [
    ('{"intent": "Multi_Hop", "confidence": 0.7}', "multi_hop", ["dense", "graph"], 0.7), ('```json\n{"intent": "comparison"}\n```', "comparison", ["dense", "bm25"], 0.8),
    ('{"intent": "weather"}', "factual_lookup", ["dense"], 0.8), ("{}", "factual_lookup", ["dense"], 0.8),
    ('{"intent": null}', "factual_lookup", ["dense", "bm25"], 0.0), ("junk", "factual_lookup", ["dense", "bm25"], 0.0), (None, "factual_lookup", ["dense", "bm25"], 0.0),
])
def test_routing(spark, raw, intent, strategies, confidence):
    d = _one(spark, raw, A.parse_routing)
    assert (d.intent, d.strategies, d.confidence) == (intent, strategies, confidence)


@pytest.mark.parametrize("raw, grade, score", [
    ('{"grade": "poor", "relevance_score": 0.2}', "POOR", 0.2), ('```\n{"grade": "ABSENT"}\n```', "ABSENT", 0.5), ('{"grade": "meh"}', "GOOD", 0.5), ("{}", "GOOD", 0.5), ("x", "GOOD", 0.5), (None, "GOOD", 0.5),
])
def test_grades(spark, raw, grade, score):
    d = _one(spark, raw, A.parse_grade)
    assert (d.grade, d.relevance_score) == (grade, score)


def test_rules(spark):
    rows = ["Compare a and b", "run(x) code", "who owns it", "what is ABC", "why", None]
    got = [r.i for r in spark.createDataFrame([(n, q) for n, q in enumerate(rows)], "n int, q string").select("n", A.route_by_rule("q").alias("i")).orderBy("n").collect()]
    assert got == ["comparison", "code_or_formula", "multi_hop", "keyword_exact", "factual_lookup", "factual_lookup"]
    assert _one(spark, "How does the cache work?", A.rewrite_by_rule) == "the cache work" and _one(spark, "why", A.rewrite_by_rule) == "why"


def _state(spark):
    grades = spark.createDataFrame([(1, "q1", "GOOD", 0.9), (2, "why x", "POOR", 0.3), (3, "why y", "POOR", 0.3), (4, "q4", "ABSENT", 0.2), (5, "q5", "ABSENT", 0.2)], "query_id long, query string, grade string, relevance_score double")
    found = spark.createDataFrame([(i, f"old{i}", 0.5, 1) for i in (1, 2, 3, 5)], "query_id long, chunk_id string, score double, rank int")
    new = spark.createDataFrame([(2, "new2", 0.8, 1)], found.schema)
    new_grades = spark.createDataFrame([(2, "GOOD", 0.8), (3, "ABSENT", 0.0)], "query_id long, grade string, relevance_score double")
    web = spark.createDataFrame([(3, "web3", 0.6, 1), (4, "web4", 0.6, 1)], found.schema)
    return grades, found, (lambda redone: (new, new_grades)), web


def test_gate(spark):
    grades, found, retry, web = _state(spark)
    decisions, chunks = A.crag_gate(grades, found, retry, web)
    d = {r.query_id: (r.grade, r.relevance_score, r.sufficient, r.rewritten_query, r.web_search_used) for r in decisions.collect()}
    assert d == {1: ("GOOD", 0.9, True, None, False), 2: ("GOOD", 0.8, True, "x", False), 3: ("ABSENT", 0.0, False, "y", False), 4: ("ABSENT", 0.2, False, None, True), 5: ("ABSENT", 0.0, False, None, False)}
    assert {(r.query_id, r.chunk_id) for r in chunks.collect()} == {(1, "old1"), (2, "new2"), (3, "old3"), (4, "web4"), (5, "old5")}
    off, same = A.crag_gate(grades, found, retry, web, Settings(crag_enabled=False))
    assert {r.grade for r in off.collect()} == {"GOOD"} and same.count() == 4
    none, _ = A.crag_gate(grades, found, lambda redone: (found.limit(0), grades.limit(0)), None)
    assert not any(r.web_search_used for r in none.collect())


def test_web(spark):
    rows = [(1, i, f"u{i}", "t", "" if i == 1 else "x" * 2000) for i in range(6)]
    got = A.web_chunks(spark.createDataFrame(rows, "query_id long, pos int, url string, title string, content string")).orderBy("rank").collect()
    assert [(r.source, r.rank, len(r.text), r.score) for r in got] == [("u0", 1, 1500, 0.6), ("u2", 2, 1500, 0.6), ("u3", 3, 1500, 0.6)]


def test_texts(spark):
    rows = [(1, 2, "B", "s2", "b.", None, 0.5, "c2"), (1, 1, None, "s1", "First one. More.", "", 0.625, "c1")]
    df = spark.createDataFrame(rows, "query_id long, rank int, title string, source string, text string, parent_text string, score double, chunk_id string")
    assert A.prompt_context(df).first().context == "[1] (Source: )\nFirst one. More.\n\n---\n\n[2] (Source: B)\nb."
    assert A.sources_block(df).first().block == "\n## Sources\n[1] **** — `s1` *(relevance: 0.62)*\n[2] **B** — `s2` *(relevance: 0.50)*"
    q = spark.createDataFrame([(1, "q"), (2, "p")], "query_id long, query string")
    assert {r.query_id: r.answer for r in A.extractive_answer(df, q).collect()} == {1: "First one. [1]", 2: A.EMPTY_ANSWER}
    dec = spark.createDataFrame([(1, "POOR", None, False), (2, "ABSENT", None, True)], "query_id long, grade string, rewritten_query string, web_search_used boolean")
    ev = A.stream_events(q, df, dec, A.extractive_answer(df, q)).orderBy("query_id", "seq").collect()
    assert [(r.query_id, r.type) for r in ev] == [(1, t) for t in ("chunk_meta", "crag_update", "token", "sources", "done")] + [(2, t) for t in ("chunk_meta", "token", "done")]
    frame = spark.createDataFrame([("token", '{"text":"a\\nb"}')], "t string, p string").select(A.read_sse(A.sse_frame(F.col("t"), F.col("p"))).alias("r")).first().r
    assert (frame.type, frame.payload) == ("token", '{"text":"a\\nb"}')


@pytest.mark.parametrize("answer, n, want", [("[1][1][2]", 4, 0.5), ("[0][99]", 2, 0.0), ("x", 0, 0.0), (None, 3, 0.0), ("[1]", 16, 0.062)])
def test_utilisation(spark, answer, n, want):
    assert _one(spark, answer, lambda c: A.context_utilisation(c, F.lit(n))) == want


def test_providers():
    assert A.resolve_provider()["provider"] == "offline"
    with pytest.raises(ValueError):
        A.resolve_provider("custom")
    with pytest.raises(ValueError):
        A.resolve_provider("custom", base_url="http://x", keys={"offline": "k"})
    got = A.resolve_provider("custom", base_url="http://x", api_key="k", model="m")
    assert got["base_url"] == "http://x" and got["model"] == "m"
