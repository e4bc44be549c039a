import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexlode.config import Settings
from lexlode.operators.chunking import chunk_documents, chunk_starts, chunk_text, estimate, hashing_embedder, split_sentences

CFG = Settings(chunk_size_tokens=8, semantic_similarity_threshold=-1.0, parent_chunk_size_tokens=8, chunk_overlap_tokens=2)
TEXT = st.text(st.sampled_from(list("ab. AB\n!?é")), max_size=200)


def test_boundaries():
    assert chunk_starts([5, 5, 5], [float("nan"), 0.82, 0.81], 0.82, 256) == [0, 2]
    assert chunk_starts([200, 56, 1], [float("nan"), 1, 1], 0.5, 256) == [0, 2]
    assert chunk_starts([300, 1], [float("nan"), 1], 0.5, 256) == [0, 1]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_chunks_cover_sentences(text):
    parts = split_sentences(text)
    got = chunk_text(text, hashing_embedder(8), CFG)
    assert " ".join(c[3] for c in got) == " ".join(parts)
    for (first, start, end, body, parent), nxt in zip(got, [*[g[0] for g in got[1:]], len(parts)]):
        own = parts[first:nxt]
        assert body == " ".join(own) and start >= 0
        assert len(own) == 1 or sum(map(estimate, own)) <= CFG.chunk_size_tokens


def test_embedder():
    v = hashing_embedder(16)(["Map map the", "", "map"])
    assert v[0].max() == 2 and v[1].sum() == 0 and np.array_equal(v[0], 2 * v[2])


def test_table(spark):
    rows = [("d1", "s", "text", "T", "One is here. Two is there. Three.", {"lang": "en"}), ("d2", "s", "pdf", None, "", None), ("d3", "s", "pdf", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, source string, doc_type string, title string, text string, metadata map<string,string>")
    got = chunk_documents(df).orderBy("chunk_index").collect()
    assert {r.doc_id for r in got} == {"d1"} and got[0].metadata == {"lang": "en", "doc_type": "text"} and len(got[0].chunk_id) == 16
    assert [r.chunk_index for r in got] == list(range(len(got))) and chunk_documents(df.limit(0)).count() == 0


def test_batches_are_bounded():
    import pyarrow as pa

    from lexlode.operators.chunking import OUT_CHARS, _chunker

    text = " ".join(f"Word{i} is number {i} of many." for i in range(300))
    n = 300
    b = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(n)]), *(pa.array(["x"] * n) for _ in range(2)), pa.array([text] * n), pa.array([[("k", "v")]] * n, pa.map_(pa.string(), pa.string()))],
                                   names=["doc_id", "source", "title", "text", "metadata"])
    cfg = Settings()
    out = list(_chunker(cfg, hashing_embedder)(iter([b])))
    sizes = [sum(map(len, o.column("text").to_pylist())) + sum(map(len, o.column("parent_text").to_pylist())) for o in out]
    assert sum(sizes) > 10 * OUT_CHARS and max(sizes) < OUT_CHARS + 2 * len(text)
    one = chunk_text(text, hashing_embedder(cfg.embed_dim), cfg)
    got = [(d, k, s, e, t, p) for o in out for d, k, s, e, t, p in zip(*(o.column(c).to_pylist() for c in ("doc_id", "chunk_index", "start_char", "end_char", "text", "parent_text")))]
    assert got == [(f"d{i}", k, *c[1:]) for i in range(n) for k, c in enumerate(one)]


def test_offsets_of_a_long_document_in_parts(monkeypatch):
    """One document that is longer than a batch may be: its chunks go on in the next batch, offsets and all."""
    import pyarrow as pa

    from lexlode.operators import chunking

    monkeypatch.setattr(chunking, "OUT_CHARS", 5_000)
    text = " ".join(f"Word{i} is number {i} of many." for i in range(200))
    b = pa.RecordBatch.from_arrays([pa.array(["d"]), *(pa.array(["x"]) for _ in range(2)), pa.array([text]), pa.array([[("k", "v")]], pa.map_(pa.string(), pa.string()))], names=["doc_id", "source", "title", "text", "metadata"])
    out = list(chunking._chunker(Settings(), hashing_embedder)(iter([b])))
    want = chunk_text(text, hashing_embedder(Settings().embed_dim), Settings())
    assert len(out) > 10 and [(s, e) for o in out for s, e in zip(o.column("start_char").to_pylist(), o.column("end_char").to_pylist())] == [c[1:3] for c in want]
    assert [p for o in out for p in o.column("parent_text").to_pylist()] == [c[4] for c in want]


def test_parents_of_whole_texts(monkeypatch):
    """Short texts, whose windows are the whole text each time: every batch still holds about OUT_CHARS at most."""
    import pyarrow as pa

    from lexlode.operators import chunking

    monkeypatch.setattr(chunking, "OUT_CHARS", 50_000)
    text = "? ".join(f"Word{i} and more" for i in range(60))
    b = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(50)]), *(pa.array(["x"] * 50) for _ in range(2)), pa.array([text] * 50), pa.array([[("k", "v")]] * 50, pa.map_(pa.string(), pa.string()))], names=["doc_id", "source", "title", "text", "metadata"])
    out = [o.column("parent_text").to_pylist() for o in chunking._chunker(Settings(), hashing_embedder)(iter([b]))]
    assert set(p for o in out for p in o) == {text} and len(out) > 10 and max(sum(map(len, o)) for o in out) < 50_000 + 2 * len(text)


def test_offsets_without_windows(spark):
    """Offsets alone need no windows: none are made or sent, a batch of documents gives no more text than it has, and the offsets are the same."""
    import pyarrow as pa

    from lexlode.operators.chunking import _chunker

    text = " ".join(f"Word{i} is number {i} of many." for i in range(300))
    b = pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(100)]), *(pa.array(["x"] * 100) for _ in range(2)), pa.array([text] * 100), pa.array([[("k", "v")]] * 100, pa.map_(pa.string(), pa.string()))], names=["doc_id", "source", "title", "text", "metadata"])
    out = list(_chunker(Settings(), hashing_embedder, parents=False)(iter([b])))
    assert "parent_text" not in out[0].schema.names and sum(o.nbytes for o in out) < 10 * b.nbytes
    want = chunk_text(text, hashing_embedder(Settings().embed_dim), Settings())
    assert [(s, e) for o in out for s, e in zip(o.column("start_char").to_pylist(), o.column("end_char").to_pylist())] == [c[1:3] for c in want] * 100
    df = spark.createDataFrame([("d1", "s", "text", "T", text, {"lang": "en"})], "doc_id string, source string, doc_type string, title string, text string, metadata map<string,string>")
    whole, bare = chunk_documents(df), chunk_documents(df, parents=False)
    assert bare.columns == [c for c in whole.columns if c != "parent_text"]
    assert bare.orderBy("chunk_index").collect() == whole.drop("parent_text").orderBy("chunk_index").collect()
