import numpy as np
import pytest

from lexlode.llm.distinctive import distinctive_terms, parsimonious, terms


def brute(docs, weight=0.1, rounds=20_000):
    """Expectation maximisation record by record, run to its limit, in plain Python."""
    from collections import Counter

    tf = {d: Counter(terms(t)) for d, t in docs.items()}
    cf = sum(tf.values(), Counter())
    total = sum(cf.values())
    out = {}
    for d, c in tf.items():
        p = {t: n / sum(c.values()) for t, n in c.items()}
        for _ in range(rounds):
            e = {t: n * weight * p[t] / ((1 - weight) * cf[t] / total + weight * p[t]) for t, n in c.items()}
            s = sum(e.values())
            p = {t: v / s for t, v in e.items()}
        out |= {(d, t): v for t, v in p.items()}
    return out


DOCS = {"a": "The map of the rail. Rail rail rail!", "b": "the sea and the map", "c": "the the the", "d": "É-été x_1 ２ हिन्दी", "e": ""}


def test_against_brute_force(spark):
    rows = [*DOCS.items(), ("a", DOCS["a"]), ("f", None), (None, "lost")]
    df = spark.createDataFrame(rows, "chunk_id string, text string").selectExpr("*", "1 as term", "2 as score")
    got = {(r.chunk_id, r.term): r.score for r in distinctive_terms(df).collect()}
    want = brute(DOCS)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
    assert got[("a", "rail")] > got[("a", "the")]
    assert [(r.term, r.tf, r.df) for r in distinctive_terms(df, min_tf=4).collect()] == [("rail", 4, 1)]
    assert distinctive_terms(df.limit(0)).count() == 0


def test_all_terms_rare_or_hot(spark, monkeypatch):
    import lexlode.llm.distinctive as D

    df = spark.createDataFrame(list(DOCS.items()), "chunk_id string, text string")
    base = {(r.chunk_id, r.term): (r.df, round(r.score, 9)) for r in distinctive_terms(df).collect()}
    monkeypatch.setattr(D, "SHARE", 3)
    assert {(r.chunk_id, r.term): (r.df, round(r.score, 9)) for r in distinctive_terms(df).collect()} == base


def test_converged():
    """Against expectation maximisation from the raw shares, run for long; every record to its own limit."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(2, 30))
        tf, bg = rng.integers(1, 9, n).astype(float), rng.random(n)
        bg /= bg.sum() * 2
        p = tf / tf.sum()
        for _ in range(200_000):
            e = tf * 0.1 * p / (0.9 * bg + 0.1 * p)
            p = e / e.sum()
        assert parsimonious(tf, bg, np.array([0])) == pytest.approx(p, abs=1e-4)


def test_ranks_planted_terms(spark):
    """Nearly all terms met often in one chunk and hardly elsewhere are among its ten most distinctive: figures in the README."""
    from collections import Counter

    import pyarrow.parquet as pq

    rows = {r["chunk_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.1/chunks.parquet", columns=["chunk_id", "text"]).to_pylist() if r["text"]}
    counts = {c: Counter(terms(t)) for c, t in rows.items()}
    df, cf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        cf.update(c)
    total, n = sum(cf.values()), 0
    hits, often = Counter(), Counter()
    for c, tf in counts.items():
        planted = {t for t, k in tf.items() if k >= 4 and 2 <= df[t] <= 6 and len(t) >= 4 and len(rows[c]) <= 2000}
        if planted:
            names = sorted(tf)
            p = parsimonious(np.array([float(tf[t]) for t in names]), np.array([cf[t] / total for t in names]), np.array([0]))
            by_score, by_count = [names[i] for i in np.argsort(-p, kind="stable")], sorted(names, key=lambda t: -tf[t])
            n += len(planted)
            for k in (1, 5, 10):
                hits[k] += len(planted & set(by_score[:k]))
                often[k] += len(planted & set(by_count[:k]))
    assert n > 100 and hits[5] / n > 0.95 and hits[1] > 10 * often[1]


def test_rows_of_a_batch_do_not_mix():
    tf, bg = np.array([2.0, 1.0, 5.0]), np.array([0.5, 0.1, 0.4])
    both = parsimonious(tf, bg, np.array([0, 2]))
    assert both[2] == pytest.approx(1.0) and both[:2] == pytest.approx(parsimonious(tf[:2], bg[:2], np.array([0])))
