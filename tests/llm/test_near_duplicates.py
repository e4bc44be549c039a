import random

import numpy as np
import pytest

from lexlode.llm import near_duplicates as N
from lexlode.llm.shingles import normal, shingle_set


def brute(rows, width=9, threshold=0.7):
    out = set()
    sets = [(i, frozenset(shingle_set(normal(t), width).tolist())) for i, t in rows if i is not None and normal(t)]
    for x in range(len(sets)):
        for y in range(x + 1, len(sets)):
            (i, a), (j, b) = sets[x], sets[y]
            if i != j and len(a & b) >= threshold * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows, i = [], 0
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.randint(5, 120))]
        for _ in range(r.choice([1, 1, 1, 2, 4])):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, (" " if r.random() < 0.5 else "  ").join(w).replace("a", "A" if r.random() < 0.3 else "a")))
            i += 1
    return rows


EDGE = [(1000, ""), (1001, None), (1002, "    "), (1003, "short"), (1004, "SHORT "), (None, "short"), (1005, "x" * 30_000), (1006, "x" * 29_000), (1007, "é" * 40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as sig")
    found = N.near_duplicates(df)
    pairs = {(r.a, r.b) for r in found.pairs().collect()}
    assert pairs == brute(rows)
    classes = {r.id: (r.class_id, r.n_links) for r in found.classes().collect()}
    assert len(classes) == sum(1 for i, t in rows if i is not None and normal(t))
    assert all(classes[a][0] == classes[b][0] for a, b in pairs)


def test_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    base = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun all day long " * 3
    rows = [(i, base + f"number {i} of the page") for i in range(17)] + corpus(5, 10)[:12]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.a, r.b) for r in N.near_duplicates(df).pairs().collect()} == brute(rows)


def test_copies_and_empty(spark):
    df = spark.createDataFrame([(i, "one and the same text of some length") for i in range(6)], "doc_id long, text string")
    found = N.near_duplicates(df)
    assert found.pairs().count() == 15 and found.links.count() == 0
    assert {(r.class_id, r.n_links) for r in found.classes().collect()} == {(0, 0)}
    assert N.near_duplicates(df.limit(0)).pairs().count() == 0


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 8, (4000, N.BINS)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < 0.7, a, a + 1).astype(np.uint16)
    assert N.survives(a, b, 0.7, N.TOLERANCE).mean() > 0.999
    assert N.survives(a, rng.permutation(a), 0.7, N.TOLERANCE).mean() == 0
    assert N.least_matches(0.7, 1e-6)[0] < 0.7 * N.STEP


def test_short_texts_against_brute_force(spark):
    r = random.Random(7)
    rows = []
    for k in range(400):
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(30, 150)))
        cut = max(1, round(len(a) * r.uniform(0.04, 0.17)))
        b = a[:-cut] + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(cut))
        rows += [(2 * k, a), (2 * k + 1, b)]
    want = brute(rows)
    assert len(want) > 250
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(p.a, p.b) for p in N.near_duplicates(df).pairs().collect()} == want
