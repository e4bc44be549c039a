from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lexlode.llm.mixing import mix_sources, quality
from lexlode.llm import mixing, packing
from lexlode.llm.packing import Index, Terms, fill, fill_report, numbered, pack_texts
from lexlode.llm.tokens import UNIT, Counter, encoder


@pytest.fixture(scope="module")
def count():
    return Counter()


def test_counts_are_exact(count):
    for t in ["", " ", "a  b", "\n\n x\n", "It's 3.5 ms!  ok", "如果队列缺失，新的", "ทีมงาน พบว่า", "x" * 300, "a b 　c", "<|endoftext|>", "tab\tand  \n end  "]:
        assert count(t) == len(encoder().encode_ordinary(t)) == count(t)


def test_bm25_against_brute_force():
    texts = ["the map of the rail", "the sea", "rail rail map", "sky"]
    t = Terms()
    index = Index(*numbered([t.vector(UNIT.findall(x)) for x in texts]))
    words = [x.split() for x in texts]
    n, avg = len(texts), np.mean([len(w) for w in words])
    for s in range(n):
        want = []
        for w in words:
            score = 0.0
            for q in set(words[s]):
                df = sum(q in x for x in words)
                tf = w.count(q)
                score += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)) if tf else 0
            want.append(score)
        assert index.scores(s) == pytest.approx(want, abs=1e-5)


def test_fill():
    t = Terms()
    texts = ["rail map"] * 3 + ["sea sky"] * 3
    index = Index(*numbered([t.vector(UNIT.findall(x)) for x in texts]))
    sizes = np.array([5, 3, 3, 5, 3, 3])
    groups = fill(sizes, np.arange(6), index, 8)
    assert sorted(i for g in groups for i in g) == list(range(6)) and all(sizes[g].sum() <= 8 for g in groups)
    assert {frozenset(g) for g in groups if 0 in g} <= {frozenset((0, 1)), frozenset((0, 2))}


def test_packing(spark, count):
    rows = [(i, f"the map of row {i} " * (i % 9 + 1)) for i in range(300)] + [(1000, "word " * 700), (1001, ""), (1002, None), (None, "lost id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as container_id", "2 as id")
    caps = [("small", 64), ("large", 256)]
    packed = pack_texts(df, caps)
    got = packed.collect()
    for kind, capacity in caps:
        room, pieces = defaultdict(int), defaultdict(list)
        for r in got:
            if r.container_kind == kind:
                room[r.container_id] += r.n_tokens
                pieces[r.doc_id].append((r.start_token, r.n_tokens))
        assert max(room.values()) <= capacity
        assert sum(room.values()) == sum(count(t) for _, t in rows if t is not None)
        assert len(pieces[7]) == 3 and 1002 not in pieces and pieces[1001] == [(0, 0)]
        long = sorted(pieces[1000])
        assert long[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(long, long[1:])) and sum(n for _, n in long) == count("word " * 700)
        assert all(len(p) == 1 for d, p in pieces.items() if d not in (7, 1000))
    report = {r.container_kind: r.used_share for r in fill_report(packed, caps).collect()}
    assert report["small"] > 0.85 and report["large"] > 0.85
    assert pack_texts(df.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        pack_texts(df, [("none", 0)])


def test_packing_does_not_depend_on_the_layout(spark, monkeypatch):
    """The same rows for two layouts, over many shards, with a hot group of copies split."""
    monkeypatch.setattr(packing, "SHARD_TEXTS", 40)
    rows = [(i, f"{'map rail stop' if i % 2 else 'sea sky wave'} {i % 17} and {i % 13} of row {i} " * (i % 5 + 1)) for i in range(400)] + [(1000 + i, "the same text again") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    caps = [("small", 64)]
    got = [sorted(map(tuple, pack_texts(df.repartition(n), caps).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 600
    shards = {r[1] >> packing.ORDINAL for r in got[0]}
    assert len({s >> packing.SALT for s in shards}) > 5 and len(shards) > len({s >> packing.SALT for s in shards})


def test_neighbours_come_from_the_collection():
    """Shards by content keep the best neighbours together: of the given documents in any order, against all of them."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    own = Terms()
    vectors = [own.vector(UNIT.findall(t)) for t in texts]
    index = Index(*numbered(vectors))
    idf, main, middle = packing.directions(vectors[::2])
    codes = np.array([int(((main @ packing.weighted(t, c, idf)) > middle) @ (1 << np.arange(packing.BITS - 1, -1, -1))) for t, c in vectors])
    shard = np.argsort(np.argsort(codes, kind="stable")) // 125
    found = []
    for seed in range(0, len(texts), 5):
        score = index.scores(seed)
        score[seed] = 0
        found.append(score[shard == shard[seed]].max() / max(score.max(), 1e-9))
    assert np.mean(found) > 0.9


def test_mixing(spark):
    rows = [(i, "a" if i < 400 else "b" if i < 460 else "c", f"some words of row {i} " * (i % 5 + 1)) for i in range(500)] + [(900, "z", "unlisted"), (901, None, "none"), (902, "a", None), (903, "a", ""), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as bucket", "2 as weight")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 4), ("gone", 0.0, 1), ("bare", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mix_sources(df, targets)
    got, rep = chosen.collect(), {r.source: r for r in report.collect()}
    most = {"a": 1, "b": 3, "c": 4}
    assert all(r.times_used <= most[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert rep[s].actual_share == pytest.approx(share, abs=0.02)
        assert abs(rep[s].used_tokens - rep[s].budget_tokens) <= max(r.n_tokens for r in got) / 2 + 1
        times = [r.times_used for r in got if r.source == s]
        assert max(times) - min(times) <= 1  # complete epochs before fractional selection
    assert rep["bare"].used_tokens == 0 and rep["bare"].actual_share == 0 and "z" not in rep
    again = mix_sources(df, targets)[0].collect()
    assert sorted(got) == sorted(again)
    short = {r.source: r for r in mix_sources(df, targets, total_tokens=10**9)[1].collect()}
    assert all(short[s].used_tokens == most[s] * short[s].available_tokens for s in most)
    assert mix_sources(df.limit(0), targets)[0].count() == 0 and mix_sources(df, targets.limit(0))[0].count() == 0


def test_mixing_narrows_the_edge(spark, monkeypatch):
    """All weights at their least, and a document stored over and over: the sorted range stays bounded, the result the same."""
    rows = [(i, "a", "word") for i in range(3000)] + [(7, "b", "word")] * 2000 + [(8, "b", "other words")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    want = sorted(mix_sources(df, targets, total_tokens=2001)[0].collect())
    assert sum(r.n_tokens * r.times_used for r in want if r.source == "a") in (1000, 1001) and len([r for r in want if r.source == "b" and r.doc_id == 7]) >= 990
    seen = []
    edges = mixing._edges
    monkeypatch.setattr(mixing, "EDGE", 50)
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    monkeypatch.setattr(mixing, "_edges", lambda *a: seen.append(edges(*a)) or seen[-1])
    assert sorted(mix_sources(df, targets, total_tokens=2001)[0].collect()) == want
    assert all(r.docs <= 50 or r.lo == r.hi for r in seen[0].collect())


def test_weights_favour_quality():
    assert quality([]) < quality(["a"] * 100) < quality([f"w{i}" for i in range(100)])
