from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.operators import models as M


def test_model_column(spark):
    def _upper():
        calls = []

        def model(rows):
            calls.append(len(rows))
            if any(r[0] == "bad" for r in rows):
                raise RuntimeError("no answer")
            return [r[0].upper() for r in rows]

        return model

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "b", "bad", "d"])], "id long, text string").coalesce(1)
    assert {r.id: r.response for r in M.model_column(df, "id", ["text"], _upper, batch=2, chars=2).collect()} == {0: "AB", 1: "B", 2: "BA", 3: "D"}
    assert {r.id: r.response for r in M.model_column(df, "id", ["text"], _upper, batch=2).collect()} == {0: "ABC", 1: "B", 2: None, 3: None}


def test_cross_encoder(spark):
    df = spark.createDataFrame([(1, "q", "a", "x", 0.1), (1, "q", "b", "bad", 0.2)], "query_id long, query string, chunk_id string, text string, score double").coalesce(1)

    got = M.scored_pairs(df, lambda: lambda rows: ["0.75" if t != "bad" else None for _, t in rows]).collect()
    assert {r.chunk_id: r.score for r in got} == {"a": 0.75, "b": 0.2}


def test_judged(spark):
    chunks = spark.createDataFrame([("c1", "the rail map"), ("c2", "sea")], "chunk_id string, text string")
    pairs = spark.createDataFrame([(1, "rail", "Rail map. Sky high cloud.", ["Rail map.", "Sky high cloud."], ["c1", "c2"]), (2, "x", "rail", ["rail"], [])], "pair_id long, query string, answer string, claim array<string>, chunk_ids array<string>")
    assert {r.pair_id: r.faithfulness for r in M.faithfulness(M.claims_by_overlap(pairs, chunks)).collect()} == {1: 0.5, 2: 0.0}
    assert {r.pair_id: r.context_precision for r in M.context_precision(M.marks_by_overlap(pairs, chunks)).collect()} == {1: 0.5}
    rel = {r.pair_id: r.answer_relevancy for r in M.answer_relevancy(pairs).collect()}
    assert 0 < rel[1] < 1 and rel[2] == 0


def test_requests(spark):
    df = spark.createDataFrame([("ok query", None), ("ab", 5), (None, 5), ("x" * 2049, 1), ("fine", 21), ("fine", 20)], "query string, top_k int")
    good, bad = M.validate_requests(df)
    assert good.count() == 2 and sorted(r.reason for r in bad.collect()) == ["query too long", "query too short", "query too short", "top_k out of range"]


def test_prefix_and_replay(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "conv_id long, turn long, text string")
    assert df.select(M.query_text("text", Settings(embed_model_name="BGE-small")).alias("q")).first().q.endswith("passages: b")
    assert [(r.text, r.before, r.after) for r in M.replay(df).orderBy("turn").collect()] == [("a", None, "b"), ("b", "a", None)]
    assert df.select(M.query_text(F.col("text")).alias("q")).first().q == "b"
