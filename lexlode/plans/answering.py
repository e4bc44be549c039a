"""Queries over routing, the gate and answers, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import SPACE
from lexlode import schemas
from lexlode.operators import answering as A
from lexlode.operators import fusion, lexical, orchestrate
from lexlode.operators.ingest import ingest
from lexlode.plans.chunking import documents
from lexlode.plans.graph import GRAPH_SQL
from lexlode.plans.reporting import logs
from lexlode.plans.retrieval import CONTEXT_SQL, FUSE_SQL, Q_SQL, RERANK_SQL, index_sql, queries, reranked, search_sql
from lexlode.plans.text import terms_sql
from lexlode.session import cut, shared_dir
from lexlode.sources.store import read_table
from lexlode.sources.tables import table

CFG = Settings()


def route_queries(spark, sf_dir):
    intent = A.route_by_rule("query")
    return logs(spark, sf_dir).where("query is not null").select("id", intent.alias("intent"), F.array_join(A.strategies_of(intent), ",").alias("strategies"))


def parse_routing(spark, sf_dir):
    """Decisions in recorded classifier output: plain, fenced, of an unknown intent, or broken, by id."""
    body = F.to_json(F.struct("intent", F.lit(0.9).alias("confidence")), {"ignoreNullFields": "false"})
    raw = F.when(F.col("id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("id") % 5 == 1, F.lit('{"intent": "Weather", "confidence": 0.4}')).when(F.col("id") % 5 == 2, F.lit("not json")).otherwise(body)
    d = A.parse_routing(raw)
    return logs(spark, sf_dir).select("id", d["intent"].alias("intent"), F.array_join(d["strategies"], ",").alias("strategies"), d["confidence"].alias("confidence"))


def dispatch(spark, sf_dir):
    q = logs(spark, sf_dir).select(F.col("id").alias("query_id"), F.from_json("strategies", "array<string>").alias("strategies"))
    return A.dispatch(q).groupBy("retriever").agg(F.count("*").alias("n"), F.sum((F.col("pos") == 0).cast("long")).alias("first"))


def parse_grade(spark, sf_dir):
    """Grades in recorded judge output: plain, fenced, in small letters, unknown, or broken, by id."""
    body = lambda g: F.concat(F.lit('{"grade": "'), g, F.lit('", "relevance_score": 0.7}'))
    g = F.coalesce("crag_grade", F.lit("GOOD"))
    raw = (F.when(F.col("id") % 5 == 0, F.concat(F.lit("```json\n"), body(g), F.lit("\n```"))).when(F.col("id") % 5 == 1, body(F.lower(g)))
           .when(F.col("id") % 5 == 2, body(F.lit("MAYBE"))).when(F.col("id") % 5 == 3, F.lit("broken {")).otherwise(body(g)))
    d = A.parse_grade(raw)
    return logs(spark, sf_dir).select("id", d["grade"].alias("grade"), d["relevance_score"].alias("relevance_score"), d["has_sufficient_context"].alias("sufficient"))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(reranked(spark, sf_dir), "ranked")


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded web results: two per query, one of them empty for every third query."""
    q = queries(spark, sf_dir)
    return q.select("query_id", F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), F.concat(F.lit(f"https://example.org/{i}/"), F.col("query_id").cast("string")).alias("url"),
                    F.concat(F.lit(f"Result {i}: "), "query").alias("title"), F.when((F.col("query_id") % 3 == 0) & F.lit(i == 1), F.lit("")).otherwise(F.repeat("query", 40)).alias("content")) for i in range(2)))).alias("r")).select("query_id", "r.*")


def web_chunks(spark, sf_dir):
    w = A.web_chunks(_web(spark, sf_dir))
    return w.select("query_id", "chunk_id", "source", F.length("text").cast("long").alias("n_chars"), "score", F.col("rank").cast("long").alias("rank"))


def _gate(spark, sf_dir):
    q, found = queries(spark, sf_dir), ranked(spark, sf_dir)
    grades = A.grade_by_score(found, q)

    index, c = lexical.Bm25Index(table(spark, sf_dir, "chunks"), CFG), lexical.distinct_chunks(table(spark, sf_dir, "chunks"))

    def retry(redone):
        """Retrieve once more with the rewritten queries, and grade what comes."""
        hits = index.search(redone, CFG.retrieval_top_k).select("query_id", "chunk_id", "score", "rank")
        again = cut(fusion.rerank(hits.join(c.select("chunk_id", "source", "title", "text", "parent_text"), "chunk_id").join(redone, "query_id"), CFG.final_top_k), "gate-again")
        return again, A.grade_by_score(again, redone)

    return A.crag_gate(grades, found, retry, A.web_chunks(_web(spark, sf_dir))), found, q


def crag_gate(spark, sf_dir):
    (decisions, chunks), _, _ = _gate(spark, sf_dir)
    n = chunks.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    return decisions.join(n, "query_id", "left").select("query_id", "grade", F.round("relevance_score", 9).alias("relevance_score"), "sufficient", "rewritten_query", "web_search_used", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def prompt_context(spark, sf_dir):
    p = A.prompt_context(ranked(spark, sf_dir)).join(queries(spark, sf_dir), "query_id")
    return p.select("query_id", A.user_prompt(F.col("context"), F.col("query")).alias("prompt"))


def sources_block(spark, sf_dir):
    return A.sources_block(ranked(spark, sf_dir))


def citations(spark, sf_dir):
    c = A.citations(ranked(spark, sf_dir))
    return c.select("query_id", F.col("number").cast("long").alias("number"), "title", "source", "chunk_id", F.round("score", 9).alias("score"))


def extractive_answers(spark, sf_dir):
    return A.extractive_answer(ranked(spark, sf_dir), queries(spark, sf_dir))


def context_utilisation(spark, sf_dir):
    e = table(spark, sf_dir, "eval_inputs")
    return e.select("pair_id", A.context_utilisation("answer", F.size("chunk_ids")).alias("context_utilisation"))


def mean_chunk_score(spark, sf_dir):
    return A.mean_chunk_score(ranked(spark, sf_dir))


def sse_events(spark, sf_dir):
    (decisions, _), found, q = _gate(spark, sf_dir)
    e = A.stream_events(q, found, decisions, A.extractive_answer(found, q))
    return e.select("query_id", F.col("seq").cast("long").alias("seq"), "type", A.read_sse(A.sse_frame(F.col("type"), F.col("payload")))["type"].alias("read_type"))


def retrieve(spark, sf_dir):
    final, _ = orchestrate.retrieve(queries(spark, sf_dir), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "triples"))
    return final.select("query_id", "chunk_id", "retriever", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), F.round("rrf_score", 9).alias("rrf_score"))


def retriever_hits(spark, sf_dir):
    return orchestrate.retrieve(queries(spark, sf_dir), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "triples"))[1]


def retrieve_stored(spark, sf_dir):
    """Ingest the documents, retrieve over the stores and over the same chunks without them: rows of both, and how many are the same."""
    base, cfg = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", Settings(nprobe=CFG.nlist, text_chars=0, field_chars=0)
    ingest(documents(spark, sf_dir), base, cfg)
    q, keys = queries(spark, sf_dir), ["query_id", "chunk_id", "retriever", "rank", "score"]
    rows = lambda index: cut(orchestrate.complete(*orchestrate.retrieve_with(q, index, cfg))[0].withColumn("score", F.round("score", 9)).select(*keys), "stored-rows")
    from_store = rows(orchestrate.Indexes.load(spark, base, cfg))
    chunks = read_table(spark, f"{base}/vectors", schemas.STORED_VECTOR).drop("vector", "cell")
    built = rows(orchestrate.Indexes.build(chunks, read_table(spark, f"{base}/graph/triples", schemas.TRIPLE), cfg))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(from_store, "n_stored").join(F.broadcast(count(built, "n_built"))).join(F.broadcast(count(from_store.intersect(built), "n_same")))


def web_first_source(spark, sf_dir):
    """Three sources in turn: one that is down, one that knows two queries of three, and one that knows them all."""
    def down(asked):
        raise ConnectionError("no network")

    some = lambda asked: _web(spark, sf_dir).join(asked.where("query_id % 3 <> 0").select("query_id"), "query_id", "left_semi")
    every = lambda asked: _web(spark, sf_dir).join(asked.select("query_id"), "query_id", "left_semi")
    got = A.first_source(queries(spark, sf_dir), [("down", down), ("some", some), ("every", every)])
    return got.select("query_id", F.col("pos").cast("long").alias("pos"), "url", "source")


def json_responses(spark, sf_dir):
    """Responses read back from their JSON."""
    (decisions, _), found, q = _gate(spark, sf_dir)
    made = A.json_response(q, found, decisions, A.extractive_answer(found, q))
    j = F.from_json("response", "query string, answer string, sources array<struct<number:int,chunk_id:string>>, grade string, rewritten_query string, web_search_used boolean")
    read = made.select("query_id", j.alias("j"))
    return read.select("query_id", "j.query", "j.grade", "j.web_search_used", F.array_join(F.transform("j.sources", lambda s: s["chunk_id"]), ",").alias("sources"), F.col("j.answer").isNotNull().alias("answered"))


def provider_list(spark, sf_dir):
    return A.providers(spark, {"custom": "a key"}).select("id", "needs_key", "available")


QUERIES = {f.__name__: f for f in (route_queries, parse_routing, dispatch, parse_grade, web_chunks, crag_gate, prompt_context, sources_block, citations, extractive_answers,
                                   context_utilisation, mean_chunk_score, sse_events, retrieve, retriever_hits, retrieve_stored, web_first_source, json_responses, provider_list)}

_L = "l AS (SELECT DISTINCT ON (id) * FROM query_logs)"
_CASE = "CASE " + " ".join("WHEN regexp_matches(query, '" + r.replace("'", "''") + f"') THEN '{i}'" for i, r in A.RULES) + " ELSE 'factual_lookup' END"
_STRAT = "CASE intent " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in A.STRATEGIES.items()) + " END"
_REWRITE = r"""coalesce(nullif(regexp_replace(regexp_replace(query, '(?i)^((who|what|which|how|why|when|where|can|does|do|is|are|please|explain|compare|describe|list|show|tell me)\b\s*)+|[?.!]+$', '', 'g'), '^\s+|\s+$', '', 'g'), ''), query)"""
_GRADES = f"""{RERANK_SQL}, b AS (SELECT query_id, max(score) AS best, count(*) AS n FROM final GROUP BY 1),
g0 AS (SELECT q.query_id, q.query, best, coalesce(n, 0) AS n, CASE WHEN n IS NULL OR best <= 0 THEN 'ABSENT' WHEN best < {CFG.crag_relevance_threshold} THEN 'POOR' ELSE 'GOOD' END AS grade FROM q LEFT JOIN b USING (query_id)),
q2 AS (SELECT query_id, {_REWRITE} AS query FROM g0 WHERE grade = 'POOR'), {search_sql('t', CFG.retrieval_top_k, 'q2', 'again')},
pair2 AS (SELECT x.query_id, x.chunk_id, x.rank, list_distinct({terms_sql('query')}) AS ql, {terms_sql('ctx')} AS cl FROM tagain_hits x JOIN ctx USING (chunk_id) JOIN q2 USING (query_id)),
sc2 AS (SELECT *, CASE WHEN len(ql) > 0 THEN CAST(len(list_intersect(ql, cl)) AS DOUBLE) / len(ql) ELSE 0 END AS score FROM pair2),
f2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank, chunk_id) AS r FROM sc2) WHERE r <= {CFG.final_top_k}),
b2 AS (SELECT query_id, max(score) AS again, count(*) AS n_again FROM f2 GROUP BY 1),
g AS (SELECT g0.*, again, coalesce(n_again, 0) AS n_again FROM g0 LEFT JOIN b2 USING (query_id)),
d AS (SELECT *, CASE WHEN grade = 'POOR' THEN CASE WHEN again IS NULL OR again <= 0 THEN 'ABSENT' WHEN again < {CFG.crag_relevance_threshold} THEN 'POOR' ELSE 'GOOD' END ELSE grade END AS final_grade FROM g)"""
_BUCKET = f"CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {CFG.embed_dim}"
_K = CFG.retrieval_top_k
_RETRIEVE = f"""{GRAPH_SQL}, {index_sql('t', "coalesce(text, '')")}, {search_sql('t', _K)},
ro AS (SELECT query_id, {_STRAT} AS strategies FROM (SELECT query_id, {_CASE} AS intent FROM q)),
cv AS (SELECT chunk_id, {_BUCKET} AS bucket, CAST(count(*) AS DOUBLE) AS w FROM (SELECT chunk_id, unnest(l) AS term FROM t_c) GROUP BY ALL),
qv AS (SELECT query_id, {_BUCKET} AS bucket, CAST(count(*) AS DOUBLE) AS w FROM (SELECT query_id, unnest({terms_sql('query')}) AS term FROM q) GROUP BY ALL),
cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM cv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY 1),
dn AS (SELECT query_id, chunk_id, sum(qv.w * cv.w) / (any_value(qn.norm) * any_value(cn.norm)) AS score FROM qv JOIN cv USING (bucket) JOIN cn USING (chunk_id) JOIN qn USING (query_id) GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dn),
lists AS (SELECT query_id, chunk_id, score, 'bm25' AS retriever FROM t_hits JOIN ro USING (query_id) WHERE contains(strategies, 'bm25')
  UNION ALL SELECT query_id, chunk_id, score, 'dense' FROM dr JOIN ro USING (query_id) WHERE rank <= {_K} AND contains(strategies, 'dense')
  UNION ALL SELECT query_id, chunk_id, score, 'graph' FROM gs JOIN ro USING (query_id) WHERE contains(strategies, 'graph')),{FUSE_SQL}{CONTEXT_SQL}"""
ORACLE = {
    "extractive_answers": f"""WITH {RERANK_SQL}, a AS (SELECT query_id, regexp_replace(regexp_extract(text, '(?s)^(.*?[.!?。！？।])(?:\\s|$)|^(.*)$', 0), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') || ' [1]' AS answer FROM final WHERE rank = 1)
        SELECT query_id, coalesce(answer, '{A.EMPTY_ANSWER}') AS answer FROM q LEFT JOIN a USING (query_id)""",
    "retrieve": f"WITH {_RETRIEVE} SELECT query_id, chunk_id, retriever, rank, round(score, 9) AS score, round(rrf, 9) AS rrf_score FROM final",
    "retriever_hits": f"WITH {_RETRIEVE} SELECT query_id, retriever, count(*) AS hits FROM lists GROUP BY ALL",
    "web_first_source": f"""WITH {Q_SQL} SELECT query_id, i AS pos, 'https://example.org/' || i || '/' || query_id AS url, CASE WHEN query_id % 3 <> 0 THEN 'some' ELSE 'every' END AS source
        FROM q, range(2) t(i) WHERE NOT (query_id % 3 = 0 AND i = 1)""",
    "json_responses": f"""WITH {_GRADES}, so AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS sources FROM final GROUP BY 1)
        SELECT query_id, query, final_grade AS grade, grade = 'ABSENT' AS web_search_used, coalesce(sources, '') AS sources, true AS answered FROM d LEFT JOIN so USING (query_id)""",
    "provider_list": "SELECT * FROM (VALUES ('offline', false, true), ('local', false, true), ('hosted', true, false), ('custom', true, true)) v(id, needs_key, available)",
    "route_queries": f"WITH {_L}, r AS (SELECT id, {_CASE} AS intent FROM l WHERE query IS NOT NULL) SELECT id, intent, {_STRAT} AS strategies FROM r",
    "parse_routing": f"""WITH {_L}, r AS (SELECT id, CASE WHEN id % 5 = 1 THEN 'factual_lookup' WHEN id % 5 = 2 OR intent IS NULL THEN 'none' ELSE intent END AS intent, id % 5 AS m FROM l)
        SELECT id, CASE WHEN intent = 'none' THEN 'factual_lookup' ELSE intent END AS intent, coalesce({_STRAT}, 'dense,bm25') AS strategies, CASE WHEN intent = 'none' THEN 0e0 WHEN m = 1 THEN 0.4e0 ELSE 0.9e0 END AS confidence FROM r""",
    "dispatch": f"""WITH {_L}, s AS (SELECT id, CAST(from_json(strategies, '["VARCHAR"]') AS VARCHAR[]) AS a FROM l), e AS (SELECT id, generate_subscripts(a, 1) AS pos, unnest(a) AS retriever FROM s)
        SELECT retriever, count(*) AS n, CAST(sum((pos = 1)::INT) AS BIGINT) AS first FROM e WHERE retriever IN ('dense', 'bm25', 'graph') GROUP BY 1""",
    "parse_grade": f"""WITH {_L}, r AS (SELECT id, id % 5 AS m, upper(coalesce(crag_grade, 'GOOD')) AS g FROM l)
        SELECT id, CASE WHEN m IN (2, 3) OR g NOT IN ('GOOD', 'POOR', 'ABSENT') THEN 'GOOD' ELSE g END AS grade, CASE WHEN m = 3 THEN 0.5e0 ELSE 0.7e0 END AS relevance_score, true AS sufficient FROM r""",
    "web_chunks": f"""WITH {Q_SQL}, w AS (SELECT query_id, query, i, 'https://example.org/' || i || '/' || query_id AS url FROM q, range(2) t(i) WHERE NOT (query_id % 3 = 0 AND i = 1))
        SELECT query_id, substr(sha256(url), 1, 16) AS chunk_id, url AS source, least(1500, 40 * length(query)) AS n_chars, 0.6e0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY i) AS rank FROM w""",
    "crag_gate": f"""WITH {_GRADES} SELECT query_id, final_grade AS grade, round(CASE WHEN grade = 'ABSENT' THEN coalesce(best, 0) WHEN grade = 'POOR' THEN coalesce(again, 0) ELSE best END, 9) AS relevance_score,
        final_grade = 'GOOD' AS sufficient, CASE WHEN grade = 'POOR' THEN {_REWRITE} END AS rewritten_query, grade = 'ABSENT' AS web_search_used,
        CAST(CASE WHEN grade = 'ABSENT' THEN CASE WHEN query_id % 3 = 0 THEN 1 ELSE 2 END WHEN grade = 'POOR' AND n_again > 0 THEN n_again ELSE n END AS BIGINT) AS n_chunks FROM d""",
    "prompt_context": f"""WITH {RERANK_SQL} SELECT query_id, '## Passages' || chr(10) || chr(10) || string_agg('[' || rank || '] (Source: ' || coalesce(title, '') || ')' || chr(10) || coalesce(nullif(parent_text, ''), text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)
        || chr(10) || chr(10) || '## Question' || chr(10) || chr(10) || any_value(query) || chr(10) || chr(10) || 'Answer from the passages only and cite them as [N].' || chr(10) AS prompt FROM final GROUP BY query_id""",
    "sources_block": f"""WITH {RERANK_SQL} SELECT query_id, chr(10) || '## Sources' || chr(10) || string_agg('[' || rank || '] **' || coalesce(title, '') || '** — `' || source || '` *(relevance: ' || printf('%.2f', score) || ')*', chr(10) ORDER BY rank) AS block FROM final GROUP BY query_id""",
    "citations": f"WITH {RERANK_SQL} SELECT query_id, rank AS number, title, source, chunk_id, round(score, 9) AS score FROM final",
    "context_utilisation": r"""WITH m AS (SELECT pair_id, len(chunk_ids) AS n, list_distinct(list_transform(regexp_extract_all(coalesce(answer, ''), '\[(\d{1,9})\]', 1), lambda x: CAST(x AS INTEGER))) AS l FROM eval_inputs)
        SELECT pair_id, CASE WHEN n > 0 THEN round_even(CAST(len(list_filter(l, lambda x: x BETWEEN 1 AND n)) AS DOUBLE) / n, 3) ELSE 0 END AS context_utilisation FROM m""",
    "mean_chunk_score": f"WITH {RERANK_SQL} SELECT query_id, round_even(avg(score), 3) AS mean_chunk_score FROM final GROUP BY query_id",
    "sse_events": f"""WITH {_GRADES}, ev AS (SELECT query_id, 0 AS stage, 'chunk_meta' AS type FROM q UNION ALL SELECT query_id, 1, 'crag_update' FROM d WHERE n > 0 AND (final_grade <> 'GOOD' OR grade = 'ABSENT')
        UNION ALL SELECT query_id, 2, 'token' FROM q UNION ALL SELECT query_id, 3, 'sources' FROM d WHERE n > 0 UNION ALL SELECT query_id, 4, 'done' FROM q)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage) AS seq, type, type AS read_type FROM ev""",
}
