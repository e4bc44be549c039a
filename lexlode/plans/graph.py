"""Queries over the entity graph, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import SPACE
from lexlode.operators import graph as G
from lexlode.operators.lexical import distinct_chunks
from lexlode.plans.retrieval import Q_SQL, queries
from lexlode.plans.text import title_sql
from lexlode.session import cut
from lexlode.sources.tables import table

CFG = Settings()
K = CFG.retrieval_top_k


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_chunks(table(spark, sf_dir, "chunks").select("chunk_id", "source", "text"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "triples")


def _recorded(spark, sf_dir, form):
    """Model output as it would be recorded, made from the triples of each chunk and extractor."""
    t = triples(spark, sf_dir).where("chunk_id is not null and subject is not null and object is not null").select("chunk_id", "subject", "predicate", "object").distinct()
    one = F.struct("subject", "predicate", "object")
    if form == "json":
        return t.groupBy("chunk_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("raw"))
    tagged = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat(F.lit("<triplet> "), x["subject"], F.lit(" <subj> "), x["object"], F.lit(" <obj> "), x["predicate"]))
    return t.groupBy("chunk_id").agg(F.concat(F.lit("<s>"), F.array_join(tagged, " "), F.lit("</s>")).alias("raw"))


def triples_tagged(spark, sf_dir):
    raw = _recorded(spark, sf_dir, "tagged").withColumn("source", F.lit(""))
    return G.extract_triples(raw, "rebel").select("chunk_id", "subject", "predicate", "object")


def triples_json(spark, sf_dir):
    raw = _recorded(spark, sf_dir, "json").withColumn("source", F.lit(""))
    return G.extract_triples(raw, "llm").select("chunk_id", "subject", "predicate", "object")


def chunk_entities(spark, sf_dir):
    return G.chunk_entities(chunks(spark, sf_dir)).select("chunk_id", "label", "entity_type")


def density_filter(spark, sf_dir):
    return G.dense_chunks(chunks(spark, sf_dir)).select("chunk_id", F.col("n_entities").cast("long").alias("n_entities"), F.round("density", 6).alias("density"))


def graph_nodes(spark, sf_dir):
    return G.graph_nodes(G.chunk_entities(chunks(spark, sf_dir)), triples(spark, sf_dir)).select("label", "entity_type", "n_chunks")


def graph_edges(spark, sf_dir):
    return G.graph_edges(triples(spark, sf_dir)).select("node_a", "node_b", F.array_join("predicates", ",").alias("predicates"), "n_chunks")


def _anchors(spark, sf_dir):
    edges = cut(G.node_pairs(triples(spark, sf_dir)), "graph-edges")
    nodes = edges.select(F.explode(F.array("node_a", "node_b")).alias("label")).distinct()
    return cut(G.anchor_nodes(G.query_entities(queries(spark, sf_dir)), nodes), "graph-anchors"), edges


def anchor_nodes(spark, sf_dir):
    return _anchors(spark, sf_dir)[0].select("query_id", "label", F.col("rank").cast("long").alias("rank"))


def khop_scores(spark, sf_dir):
    anchors, edges = _anchors(spark, sf_dir)
    return G.hops(anchors, edges, CFG.graph_max_hops).select("query_id", "label", F.pow(F.lit(0.5), F.col("distance")).alias("score"))


def graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors, edges = _anchors(spark, sf_dir)
    of_nodes = G.node_chunks(G.chunk_entities(chunks(spark, sf_dir)))
    return G.search_from(anchors, edges, of_nodes, G.edge_chunks(triples(spark, sf_dir)), K, CFG.graph_max_hops)


def graph_search(spark, sf_dir):
    return graph_hits(spark, sf_dir).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (triples_tagged, triples_json, chunk_entities, density_filter, graph_nodes, graph_edges, anchor_nodes, khop_scores, graph_search)}

_S = f"'^[{SPACE}]+|[{SPACE}]+$', '', 'g'"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {_S})"


def _title(e: str) -> str:
    return f"coalesce({title_sql(_strip(e))}, '')"


_REL = ", ".join(f"'{r}'" for r in G.RELATIONS)
_RAW = "d AS (SELECT DISTINCT chunk_id, subject, predicate, object FROM triples WHERE chunk_id IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL)"
_SPANS = "regexp_extract_all(text, '\\p{Lu}\\p{Ll}+(?:[ -]\\p{Lu}\\p{Ll}+)+')"
_CH = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, source, text FROM chunks)"
_ENT = f"""{_CH}, sp AS (SELECT chunk_id, generate_subscripts(l, 1) AS pos, unnest(l) AS span FROM (SELECT chunk_id, {_SPANS} AS l FROM c)),
e AS (SELECT chunk_id, label, arg_min(kind, pos) AS entity_type FROM (SELECT chunk_id, pos, {_title('span')} AS label, CASE WHEN regexp_matches(span, '{G.ORG_END}') THEN 'ORG' ELSE 'PERSON' END AS kind FROM sp) WHERE length(label) >= 2 GROUP BY ALL)"""
_TRI = f"""t AS (SELECT * FROM (SELECT DISTINCT {_title('subject')} AS subject, lower({_strip('predicate')}) AS predicate, {_title('object')} AS object, chunk_id, source, extractor FROM triples
  WHERE subject IS NOT NULL AND object IS NOT NULL) WHERE subject <> '' AND object <> '' AND predicate <> ''),
ed AS (SELECT least(subject, object) AS node_a, greatest(subject, object) AS node_b, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates, count(DISTINCT chunk_id) AS n_chunks FROM t GROUP BY 1, 2)"""
_WORDS = "list_filter(string_split(trim(regexp_replace(lower(query), '[^\\p{L}\\p{N}_-]+', ' ', 'g')), ' '), lambda t: t <> '')"
_QE = f"""{Q_SQL}, qw AS (SELECT query_id, list_filter(regexp_extract_all(query, '\\p{{Lu}}\\p{{Ll}}+(?:[ -]\\p{{Lu}}\\p{{Ll}}+)+'), lambda s: length(s) > 1) AS found, {_WORDS} AS w FROM q),
ql AS (SELECT query_id, CASE WHEN len(found) > 0 THEN found ELSE list_filter(list_transform(generate_series(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(list_filter([w[i], w[i + 1]], lambda x: x IS NOT NULL), ' ')), lambda p: length(p) > 3) END AS l FROM qw),
qe AS (SELECT query_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS raw FROM ql), ent AS (SELECT query_id, pos, {_title('raw')} AS entity FROM qe)"""
_ANCHOR = f"""{_QE}, {_TRI}, n AS (SELECT node_a AS label FROM ed UNION SELECT node_b FROM ed),
ex AS (SELECT query_id, pos, entity, label FROM ent JOIN n ON lower(label) = lower(entity)),
pa AS (SELECT query_id, pos, entity, label FROM ent JOIN n ON contains(lower(label), lower(entity)) OR contains(lower(entity), lower(label)) WHERE entity <> '' AND (query_id, entity) NOT IN (SELECT query_id, entity FROM ex)),
ah AS (SELECT query_id, label, min(pos * 2 + late) AS seq FROM (SELECT *, 0 AS late FROM ex UNION ALL SELECT *, 1 FROM pa) GROUP BY ALL),
an AS (SELECT * FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY seq, label) AS rank FROM ah) WHERE rank <= 10)"""
_HOPS = f"""{_ANCHOR}, nb AS (SELECT node_a AS label, node_b AS nxt FROM ed WHERE node_a <> node_b UNION ALL SELECT node_b, node_a FROM ed WHERE node_a <> node_b),
h1 AS (SELECT query_id, nxt AS label, 1 AS d FROM an JOIN nb USING (label)), h2 AS (SELECT query_id, nxt AS label, 2 AS d FROM (SELECT DISTINCT query_id, label FROM h1) JOIN nb USING (label)),
h AS (SELECT query_id, label, min(d) AS d FROM (SELECT query_id, label, 0 AS d FROM an UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)"""
GRAPH_SQL = f"""{_ENT}, {_HOPS},
        ns AS (SELECT query_id, chunk_id, pow(0.5e0, d) AS score FROM h JOIN e USING (label)),
        ne AS (SELECT query_id, node_a, node_b, min(d) AS d FROM (SELECT query_id, node_a, node_b, d FROM h JOIN ed ON label = node_a UNION ALL SELECT query_id, node_a, node_b, d FROM h JOIN ed ON label = node_b) GROUP BY ALL),
        ec AS (SELECT DISTINCT least(subject, object) AS node_a, greatest(subject, object) AS node_b, chunk_id FROM t WHERE chunk_id IS NOT NULL),
        es AS (SELECT query_id, chunk_id, 0.8e0 * pow(0.5e0, d) AS score FROM ne JOIN ec USING (node_a, node_b)),
        mx AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM ns UNION ALL SELECT * FROM es) GROUP BY ALL),
        gs AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM mx) WHERE rank <= {K})"""
ORACLE = {
    "triples_tagged": f"""WITH {_RAW}, r AS (SELECT chunk_id, {_title('subject')} AS subject, lower({_strip('predicate')}) AS predicate, {_title('object')} AS object,
        row_number() OVER (PARTITION BY chunk_id ORDER BY d.subject, d.predicate, d.object) AS pos FROM d),
        k AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS n FROM r WHERE subject <> '' AND object <> '' AND predicate IN ({_REL}))
        SELECT chunk_id, subject, predicate, object FROM k WHERE n <= {CFG.tagged_cap}""",
    "triples_json": f"""WITH {_RAW}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY subject, predicate, object) AS pos FROM d),
        k AS (SELECT chunk_id, {_title('subject')} AS subject, lower({_strip('predicate')}) AS predicate, {_title('object')} AS object FROM r WHERE pos <= {CFG.json_cap})
        SELECT * FROM k WHERE subject <> '' AND predicate <> '' AND object <> ''""",
    "chunk_entities": f"WITH {_ENT} SELECT chunk_id, label, entity_type FROM e",
    "density_filter": f"""WITH {_CH}, x AS (SELECT chunk_id, len({_SPANS}) AS n_entities,
        len(list_filter(regexp_split_to_array({_strip('text')}, '[\\t-\\r ]+'), lambda t: t <> '')) AS n FROM c),
        y AS (SELECT chunk_id, n_entities, CASE WHEN n > 0 THEN n_entities / n * 100 ELSE 0 END AS density FROM x WHERE n_entities >= {CFG.density_min_entities}),
        z AS (SELECT *, row_number() OVER (ORDER BY round(density, 9) DESC, chunk_id) AS r, count(*) OVER () AS total FROM y)
        SELECT chunk_id, n_entities, round(density, 6) AS density FROM z WHERE r <= greatest(1, floor(total * {CFG.density_top_fraction}))""",
    "graph_nodes": f"""WITH {_ENT}, {_TRI}, s AS (SELECT e.label, e.entity_type, 0 AS late, e.chunk_id, (SELECT min(pos) FROM sp WHERE sp.chunk_id = e.chunk_id AND {_title('span')} = e.label) AS pos FROM e
        UNION ALL SELECT subject, 'UNKNOWN', 1, NULL, 0 FROM t UNION ALL SELECT object, 'UNKNOWN', 1, NULL, 0 FROM t)
        SELECT label, arg_min(entity_type, late || ':' || coalesce(chunk_id, '')) AS entity_type, count(DISTINCT chunk_id) AS n_chunks FROM s GROUP BY label""",
    "graph_edges": f"WITH {_TRI} SELECT * FROM ed",
    "anchor_nodes": f"WITH {_ANCHOR} SELECT * FROM an",
    "khop_scores": f"WITH {_HOPS} SELECT query_id, label, pow(0.5e0, d) AS score FROM h",
    "graph_search": f"WITH {GRAPH_SQL} SELECT query_id, chunk_id, score, rank FROM gs",
}
