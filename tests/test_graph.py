import random

import pytest

from lexlode.config import Settings
from lexlode.operators import graph as G
from lexlode.operators.components import connected_components


def test_parsers(spark):
    tagged = "<s><triplet> ann lee <subj> acme <obj> employer <triplet> x <subj> <obj> author <triplet> a <subj> b <obj> likes <triplet> a b</s>"
    js = ['```json\n[{"subject": "ann", "predicate": "Author", "object": "o\'neil"}, 5, {"subject": "x"}]\n```', '{"subject": "a", "predicate": "b", "object": "c"}', "garbage", None,
          "[" + ",".join('{"subject":"s%d","predicate":"p","object":"o"}' % i for i in range(8)) + "]"]
    df = spark.createDataFrame([(tagged,)], "raw string").select(G.parse_tagged("raw").alias("t"))
    assert [tuple(t) for t in df.first().t] == [("Ann Lee", "employer", "Acme")]
    got = [[tuple(t) for t in r.t] for r in spark.createDataFrame([(i, x) for i, x in enumerate(js)], "i int, raw string").select("i", G.parse_json("raw").alias("t")).orderBy("i").collect()]
    assert got == [[("Ann", "author", "O'Neil")], [], [], [], [(f"S{i}", "p", "O") for i in range(5)]]
    many = "".join(f"<triplet> s{i} <subj> o <obj> author " for i in range(12))
    assert len(spark.createDataFrame([(many,)], "raw string").select(G.parse_tagged("raw").alias("t")).first().t) == 8
    with pytest.raises(ValueError):
        G.extract_triples(df, "unknown")


def test_edges_and_nodes(spark):
    t = spark.createDataFrame([("a", "Author", "b", "1", "s", "e"), ("B", "part of", "A", "2", "s", "e"), ("a", "x", "a", "3", "s", "e"), ("a", "x", "", "4", "s", "e"), ("a", "x", None, "4", "s", "e")], "subject string, predicate string, object string, chunk_id string, source string, extractor string")
    got = {(r.node_a, r.node_b): (r.predicates, r.n_chunks) for r in G.graph_edges(t).collect()}
    assert got == {("A", "B"): (["author", "part of"], 2), ("A", "A"): (["x"], 1)}
    e = spark.createDataFrame([("9", "A", "s", "ORG", 0), ("8", "A", "s", "PERSON", 3)], "chunk_id string, label string, source string, entity_type string, pos int")
    assert {r.label: (r.entity_type, r.n_chunks) for r in G.graph_nodes(e, t).collect()} == {"A": ("PERSON", 2), "B": ("UNKNOWN", 0)}


def test_hops_against_brute_force(spark):
    r = random.Random(5)
    edges = sorted({tuple(sorted(r.sample([f"n{i}" for i in range(14)], 2))) for _ in range(18)})
    anchors = [(1, "n0"), (1, "n5"), (2, "n3")]
    e = spark.createDataFrame(edges, "node_a string, node_b string")
    got = {(x.query_id, x.label): x.distance for x in G.hops(spark.createDataFrame(anchors, "query_id long, label string"), e).collect()}
    want = {}
    for q, a in anchors:
        seen, level = {a: 0}, [a]
        for d in (1, 2):
            level = [y for x in level for p in edges for y in p if x in p and y not in seen]
            seen |= {y: d for y in level if y not in seen}
        for n, d in seen.items():
            want[(q, n)] = min(d, want.get((q, n), 9))
    assert got == want


def test_anchors(spark):
    nodes = spark.createDataFrame([(x,) for x in ("Sparse Shard", "Shard", "Ok", "Map Of The Sea", "Sea")], "label string")
    ents = spark.createDataFrame([(1, 0, "sparse shard"), (1, 1, "Deep Sea Ok"), (2, 0, "Map"), (3, 0, "zz")], "query_id long, pos int, entity string")
    got = {(r.query_id, r.label): r.rank for r in G.anchor_nodes(ents, nodes).collect()}
    assert got == {(1, "Sparse Shard"): 1, (1, "Ok"): 2, (1, "Sea"): 3, (2, "Map Of The Sea"): 1}


def test_density(spark):
    rows = [(f"c{i:02}", "Ann Lee met Bob Ray " + "word " * i) for i in range(10)] + [("one", "Ann Lee"), ("none", ""), ("tie1", "Ann Lee met Bob Ray"), ("tie2", "Ann Lee met Bob Ray")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert {r.chunk_id for r in G.dense_chunks(df).collect()} == {"c00", "tie1", "tie2"}
    assert {r.chunk_id for r in G.dense_chunks(df, Settings(density_top_fraction=0.01)).collect()} == {"c00"}
    assert G.dense_chunks(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(7)
    for n, m in ((40, 30), (60, 80)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100, 101), (101, 100), (103, 103), (None, 1)] + [(200 + i, 201 + i) for i in range(40)]
        parent = {x: x for e in edges if None not in e for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if a is not None:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        got = {c.node: c.component for c in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_share_their_walk(spark):
    """200 queries of one anchor: what is kept between the hops has a row for each node, not for each query and node."""
    import os

    from lexlode.session import clear_cuts, shared_dir

    clear_cuts(spark)
    e = spark.createDataFrame([("hub", f"n{i}") for i in range(50)] + [(f"n{i}", f"z{i}") for i in range(50)], "node_a string, node_b string")
    got = G.hops(spark.createDataFrame([(q, "hub") for q in range(200)], "query_id long, label string"), e)
    assert got.groupBy("query_id").agg({"distance": "sum"}).distinct().collect()[0][1] == 50 + 2 * 50 and got.count() == 200 * 101
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    kept = sum(spark.read.parquet(f"{own}/{n}").count() for n in os.listdir(own) if n.startswith("graph-hops"))
    assert kept == 101


def test_search_equals_brute_force(spark):
    r = random.Random(5)
    pairs = sorted({tuple(sorted((f"n{r.randrange(25)}", f"n{r.randrange(25)}"))) for _ in range(35)})
    of_edges = sorted({(*r.choice(pairs), f"c{r.randrange(60):02}") for _ in range(120)})
    of_nodes = sorted({(f"n{r.randrange(25)}", f"c{r.randrange(60):02}") for _ in range(60)})
    anchors = [(q, f"n{r.randrange(25)}") for q in range(90) for _ in range(2)]
    for k in (2, 4, 50):
        want = set()
        for q in range(90):
            at, level = {a: 0 for p, a in anchors if p == q}, {a for p, a in anchors if p == q}
            for d in (1, 2):
                level = {y for x in level for p in pairs for y in p if x in p and y not in at}
                at |= {y: d for y in level}
            score = {}
            for n, c in of_nodes:
                if n in at:
                    score[c] = max(score.get(c, 0), 0.5 ** at[n])
            for a, b, c in of_edges:
                near = min(at.get(a, 9), at.get(b, 9))
                if near < 9:
                    score[c] = max(score.get(c, 0), 0.8 * 0.5**near)
            want |= {(q, c, s, i + 1) for i, (c, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k])}
        table = lambda rows, ddl: spark.createDataFrame(rows, ddl)
        hits = G.search_from(table(anchors, "query_id long, label string"), table(pairs, "node_a string, node_b string"), table(of_nodes, "label string, chunk_id string"),
                             table(of_edges, "node_a string, node_b string, chunk_id string"), k)
        assert {(x.query_id, x.chunk_id, x.score, x.rank) for x in hits.collect()} == want


def test_lists_of_a_hub_are_short(spark):
    of_nodes = spark.createDataFrame([("hub", f"c{i:03}") for i in range(300)], "label string, chunk_id string")
    of_edges = spark.createDataFrame([("hub", f"n{i}", f"c{i:03}") for i in range(300)], "node_a string, node_b string, chunk_id string")
    got = G._lists(of_nodes, of_edges, 5).where("label = 'hub'").collect()
    assert {(r.side, r.chunk_id) for r in got} == {(s, f"c{i:03}") for s in (0, 1) for i in range(5)} and len(got) == 10
