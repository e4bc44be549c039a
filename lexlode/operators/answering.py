"""Routing, grading, the corrective gate, and the making of answers, over batches of queries."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexlode.config import Provider, Settings
from lexlode.functions.text import context_text, fence_strip, short_hash, snippet, strip
from lexlode.schemas import GRADES, INTENTS
from lexlode.session import cut

# Retrievers of each intent, in order; and of a decision that could not be made.
STRATEGIES = {
    "factual_lookup": ("dense",), "keyword_exact": ("bm25", "dense"), "comparison": ("dense", "bm25"),
    "multi_hop": ("dense", "graph"), "code_or_formula": ("bm25", "dense"),
}
FALLBACK = ("dense", "bm25")
WEB_SCORE = 0.6
EMPTY_ANSWER = "Nothing stored matches this question."
# Rules of the offline classifier: the first that matches decides.
RULES = (
    ("comparison", r"(?i)\b(compare|versus|vs\.?|difference|unterschied|diff[eé]rence|diferencia|slower|faster|better)\b|区别|違い|лучше"),
    ("code_or_formula", r"(?i)\b(code|function|formula|equation|algorithm|steps|regex|sql|implement)\b|\w+\(\w*\)"),
    ("multi_hop", r"(?i)\b(who|which .* (of|that)|what happens when|affects?|leads? to|connected)\b"),
    ("keyword_exact", r"\b[A-Z]{2,}\b|\b\w+_\w+\b|\"[^\"]+\""),
)
PROVIDERS = (
    Provider("offline", "Extractive, offline", "", ("extractive",), needs_key=False),
    Provider("local", "Local server", "http://localhost:11434/v1", (), needs_key=False),
    Provider("hosted", "Hosted service named by LEXLODE_HOSTED_URL", os.environ.get("LEXLODE_HOSTED_URL", ""), ()),
    Provider("custom", "Custom endpoint", ""),
)


def route_by_rule(query: Column | str) -> Column:
    """Intent of a query by keyword rules: the offline stand-in for a classifying model."""
    q = F.col(query) if isinstance(query, str) else query
    out = F.lit(INTENTS[0])
    for intent, rule in reversed(RULES):
        out = F.when(q.rlike(rule), F.lit(intent)).otherwise(out)
    return out


def strategies_of(intent: Column) -> Column:
    table = F.create_map(*(x for k, v in STRATEGIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(table[intent], F.array(*map(F.lit, STRATEGIES[INTENTS[0]])))


def parse_routing(raw: Column) -> Column:
    """Decision in a classifier's JSON: an unknown intent is a factual lookup, unreadable output the fallback."""
    body = F.regexp_replace(strip(raw), r"(?s)^```(?:json)?\s*(.*?)```.*$", "$1")
    j = F.from_json(body, "intent string, confidence double, reasoning string")
    intent = F.lower(strip(j["intent"]))
    known = F.coalesce(F.when(intent.isin(*INTENTS), intent).otherwise(INTENTS[0]), F.lit(INTENTS[0]))
    names_intent = F.coalesce(F.json_object_keys(body).isNotNull() & F.array_contains(F.json_object_keys(body), "intent"), F.lit(False))
    is_object = F.startswith(strip(body), F.lit("{")) & F.try_parse_json(body).isNotNull()
    read = F.struct(
        known.alias("intent"),
        strategies_of(known).alias("strategies"),
        F.coalesce(j["confidence"], F.lit(0.8)).alias("confidence"),
        F.coalesce(j["reasoning"], F.lit("")).alias("reasoning"),
    )
    unread = F.struct(
        F.lit(INTENTS[0]).alias("intent"),
        F.array(*map(F.lit, FALLBACK)).alias("strategies"),
        F.lit(0.0).alias("confidence"),
        F.lit("Default decision: no classification.").alias("reasoning"),
    )
    return F.when(F.coalesce(is_object & (j["intent"].isNotNull() | ~names_intent), F.lit(False)), read).otherwise(unread)


def dispatch(queries: DataFrame) -> DataFrame:
    """One row per query and retriever to run: query_id, retriever, pos; unknown names are skipped."""
    each = queries.select("query_id", F.posexplode("strategies").alias("pos", "retriever"))
    return each.where(F.col("retriever").isin("dense", "bm25", "graph"))


def parse_grade(raw: Column) -> Column:
    """Grade in a judge's JSON; unreadable output and unknown grades pass as GOOD."""
    body = fence_strip(raw)
    j = F.from_json(body, "grade string, relevance_score double, has_sufficient_context boolean, reasoning string")
    grade = F.upper(F.coalesce(j["grade"], F.lit("GOOD")))
    ok = F.coalesce(F.startswith(body, F.lit("{")) & F.try_parse_json(body).isNotNull(), F.lit(False))
    read = F.struct(
        F.when(grade.isin(*GRADES), grade).otherwise("GOOD").alias("grade"),
        F.coalesce(j["relevance_score"], F.lit(0.5)).alias("relevance_score"),
        F.coalesce(j["has_sufficient_context"], F.lit(True)).alias("has_sufficient_context"),
        F.coalesce(j["reasoning"], F.lit("")).alias("reasoning"),
    )
    unread = F.struct(
        F.lit("GOOD").alias("grade"),
        F.lit(0.5).alias("relevance_score"),
        F.lit(True).alias("has_sufficient_context"),
        F.lit("Parse error.").alias("reasoning"),
    )
    return F.when(ok, read).otherwise(unread)


def grade_by_score(found: DataFrame, queries: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Grade of each query by its best score: the offline judge; without chunks it is ABSENT."""
    best = found.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    g = queries.select("query_id", "query").join(best, "query_id", "left")
    grade = F.when(F.col("n").isNull() | (F.col("best") <= 0), "ABSENT").when(F.col("best") < cfg.crag_relevance_threshold, "POOR").otherwise("GOOD")
    return g.select("query_id", "query", grade.alias("grade"), F.coalesce(F.col("best"), F.lit(0.0)).alias("relevance_score"))


def rewrite_by_rule(query: Column | str) -> Column:
    """A query without its question words: the offline rewriter; the query itself if nothing is left."""
    q = F.col(query) if isinstance(query, str) else query
    bare = strip(F.regexp_replace(q, r"(?i)^((who|what|which|how|why|when|where|can|does|do|is|are|please|explain|compare|describe|list|show|tell me)\b\s*)+|[?.!]+$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), q)


def web_chunks(results: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Chunks of web results (query_id, pos, url, title, content): at most three per query, without empty ones."""
    w = Window.partitionBy("query_id").orderBy("pos", "url")
    kept = results.where("content <> ''").withColumn("n", F.row_number().over(w)).where(F.col("n") <= cfg.web_max_results)
    text = snippet("content", cfg.web_chars) if cfg.web_chars else F.col("content")
    return kept.select("query_id", short_hash("url").alias("chunk_id"), F.lit("web").alias("doc_id"), F.col("url").alias("source"), "title", text.alias("text"), text.alias("parent_text"),
                       F.lit(0).alias("chunk_index"), F.lit(WEB_SCORE).alias("score"), F.lit("web_search").alias("retriever"), F.col("n").alias("rank"))


def first_source(queries: DataFrame, sources: list) -> DataFrame:
    """Results of the first source that has any for a query: query_id, pos, url, title, content, source.

    ``sources``: (name, function from queries to results) pairs in order. Each next
    source is asked only for the queries that still have no usable result; one that fails counts as empty.
    """
    left, out = queries.select("query_id", "query"), None
    for name, ask in sources:
        try:
            got = cut(ask(left).where("content <> ''").select("query_id", "pos", "url", "title", "content", F.lit(name).alias("source")), f"web-{name}")
        except Exception:  # the next source stands in
            continue
        out = got if out is None else out.unionByName(got)
        left = left.join(got.select("query_id").distinct(), "query_id", "left_anti")
    if out is None:
        return queries.select("query_id", F.lit(0).alias("pos"), *(F.lit("").alias(c) for c in ("url", "title", "content", "source"))).limit(0)
    return out


def crag_gate(grades: DataFrame, found: DataFrame, retry, web: DataFrame | None = None, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Corrective gate; returns (decisions, chunks).

    GOOD passes. POOR is rewritten and retrieved once more through ``retry`` (queries
    -> chunks and grades); the new chunks replace the old unless there are none, and no
    web search follows. ABSENT takes web results, or keeps its chunks with a score of
    zero. With the gate off, everything passes. ``found``: query_id, chunk_id, score, rank.
    """
    if not cfg.crag_enabled:
        out = grades.select(
            "query_id", "query", F.lit("GOOD").alias("grade"), "relevance_score", F.lit(True).alias("sufficient"),
            F.lit(None).cast("string").alias("rewritten_query"), F.lit(False).alias("web_search_used"))
        return out, found
    poor = grades.where("grade = 'POOR'") if cfg.crag_max_retries > 0 else grades.where("false")
    redone = poor.select("query_id", rewrite_by_rule("query").alias("query"))
    new_found, new_grades = retry(redone)
    renewed = new_found.select("query_id").distinct().withColumn("renewed", F.lit(True))
    on_web = web.select("query_id").distinct().withColumn("on_web", F.lit(True)) if web is not None else grades.select("query_id").where("false").withColumn("on_web", F.lit(True))
    state = (
        grades.join(redone.withColumnRenamed("query", "rewritten_query"), "query_id", "left").join(renewed, "query_id", "left").join(on_web, "query_id", "left")
        .join(new_grades.select("query_id", F.col("grade").alias("new_grade"), F.col("relevance_score").alias("new_score")), "query_id", "left")
    )
    used_web = F.coalesce((F.col("grade") == "ABSENT") & F.col("on_web"), F.lit(False))
    decisions = state.select(
        "query_id", "query", F.coalesce("new_grade", "grade").alias("grade"),
        F.when((F.col("grade") == "ABSENT") & ~used_web, 0.0).otherwise(F.coalesce("new_score", "relevance_score")).alias("relevance_score"),
        (F.coalesce("new_grade", "grade") == "GOOD").alias("sufficient"), "rewritten_query", used_web.alias("web_search_used"))
    flags = state.select("query_id", F.coalesce("renewed", F.lit(False)).alias("renewed"), used_web.alias("used_web"))
    cols = ["query_id", "chunk_id", "score", "rank"]
    old = found.select(*cols).join(flags.where("not renewed and not used_web").select("query_id"), "query_id", "left_semi")
    out = old.unionByName(new_found.select(*cols))
    if web is not None:
        out = out.unionByName(web.select(*cols).join(flags.where("used_web").select("query_id"), "query_id", "left_semi"))
    return decisions, out


# ---- answers ----------------------------------------------------------------

def _in_order(value: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col("rank").alias("rank"), value.alias("v"))))


def prompt_context(ranked: DataFrame) -> DataFrame:
    """Numbered passages of each query: query_id, context. A query's passages are bounded by its top k."""
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (Source: "), F.coalesce("title", F.lit("")), F.lit(")\n"), context_text("parent_text", "text"))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(_in_order(part), lambda x: x["v"]), "\n\n---\n\n").alias("context"))


def user_prompt(context: Column, query: Column) -> Column:
    return F.concat(F.lit("## Passages\n\n"), context, F.lit("\n\n## Question\n\n"), query, F.lit("\n\nAnswer from the passages only and cite them as [N].\n"))


def sources_block(ranked: DataFrame) -> DataFrame:
    """Markdown list of each query's sources: query_id, block."""
    shown = F.format_string("%.2f", F.bround("score", 2))
    title = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] **"), F.coalesce("title", F.lit("")), F.lit("**"))
    line = F.concat(title, F.lit(" — `"), F.col("source"), F.lit("` *(relevance: "), shown, F.lit(")*"))
    listed = F.array_join(F.transform(_in_order(line), lambda x: x["v"]), "\n")
    return ranked.groupBy("query_id").agg(F.concat(F.lit("\n## Sources\n"), listed).alias("block"))


def citations(ranked: DataFrame) -> DataFrame:
    """Every passage as a numbered citation, cited in the answer or not."""
    return ranked.select("query_id", F.col("rank").alias("number"), "title", "source", "chunk_id", "score")


def extractive_answer(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """The first sentence of the best passage with its citation: the offline generator; a fixed text without passages."""
    best = ranked.where("rank = 1").select("query_id", F.concat(strip(F.regexp_extract("text", r"(?s)^(.*?[.!?。！？।])(?:\s|$)|^(.*)$", 0)), F.lit(" [1]")).alias("answer"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(EMPTY_ANSWER)).alias("answer"))


def generated_answer(ranked: DataFrame, queries: DataFrame, load, fallback=extractive_answer) -> DataFrame:
    """Answers of a model to the prompts of the queries with passages: query_id, answer.

    ``load`` runs once per task and gives a function from (prompt,) tuples to answers. Where
    a call fails the fallback answers, and a query without passages never reaches the model.
    """
    from lexlode.operators.models import model_column

    prompts = prompt_context(ranked).join(queries.select("query_id", "query"), "query_id").select("query_id", user_prompt(F.col("context"), F.col("query")).alias("prompt"))
    made = model_column(prompts, "query_id", ["prompt"], load, out="made")
    plain = fallback(ranked, queries)
    return plain.join(made, "query_id", "left").select("query_id", F.coalesce(F.nullif(strip("made"), F.lit("")), "answer").alias("answer"))


def json_response(queries: DataFrame, ranked: DataFrame, decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Response of each query as one JSON object: query_id, response.

    It holds the query, the answer, the numbered sources, the grade and whether the
    query was rewritten or the web asked. A query's sources are bounded by its top k.
    """
    source = F.struct(F.col("rank").alias("number"), "chunk_id", "title", "source", F.round("score", 4).alias("score"), snippet("text", 200).alias("text_snippet"))
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    gate = decisions.select("query_id", "grade", "rewritten_query", "web_search_used")
    row = queries.select("query_id", "query").join(answers, "query_id").join(gate, "query_id", "left").join(listed, "query_id", "left")
    body = F.struct("query", "answer", F.coalesce("sources", F.array()).alias("sources"), "grade", "rewritten_query", "web_search_used")
    return row.select("query_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def providers(spark: SparkSession, keys: dict[str, str] | None = None, catalogue: tuple[Provider, ...] = PROVIDERS) -> DataFrame:
    """The catalogue as shown to users: id, label, models, needs_key, available (it has its key and address). Keys are not shown."""
    ready = lambda p: (not p.needs_key or bool((keys or {}).get(p.id))) and (bool(p.base_url) or p.id in ("offline", "custom"))
    rows = [(p.id, p.label, list(p.models), p.needs_key, ready(p)) for p in catalogue]
    return spark.createDataFrame(rows, "id string, label string, models array<string>, needs_key boolean, available boolean")


def context_utilisation(answer: Column | str, n_chunks: Column) -> Column:
    """Share of the passages that the answer cites, to 3 decimals; 0 without passages."""
    text = F.coalesce(answer if isinstance(answer, Column) else F.col(answer), F.lit(""))
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1))
    found = F.array_distinct(F.transform(marks, lambda x: x.cast("int")))
    used = F.size(F.filter(found, lambda n: (n >= 1) & (n <= n_chunks)))
    return F.when(n_chunks > 0, F.bround(used / n_chunks, 3)).otherwise(0.0)


def mean_chunk_score(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(F.bround(F.avg("score"), 3).alias("mean_chunk_score"))


def resolve_provider(provider: str | None = None, model: str | None = None, api_key: str | None = None, base_url: str | None = None,
                     cfg: Settings = Settings(), keys: dict[str, str] | None = None, catalogue: tuple[Provider, ...] = PROVIDERS) -> dict:
    """Endpoint of a request: known providers ignore the request's address, a key is never borrowed from another provider."""
    known = {p.id: p for p in catalogue}
    pid = provider or cfg.default_provider
    p = known.get(pid, catalogue[0])
    url = p.base_url if pid in known and pid != "custom" else base_url or ""
    if pid == "custom" and not url:
        raise ValueError("a custom provider needs a base URL")
    key = api_key or (keys or {}).get(pid, "")
    if p.needs_key and not key:
        raise ValueError(f"no API key for provider {pid!r}")
    return {"provider": pid, "model": model or cfg.default_model, "base_url": url, "api_key": key, "temperature": cfg.temperature, "max_tokens": cfg.max_tokens, "timeout": cfg.llm_timeout}


def stream_events(queries: DataFrame, ranked: DataFrame, decisions: DataFrame, answers: DataFrame) -> DataFrame:
    """Events of each answer in order: query_id, seq, type, payload (JSON).

    chunk_meta shows the chunks before the gate; a query without chunks gets the fixed text and done.
    """
    def event(rows: DataFrame, stage: int, kind: str, payload: Column) -> DataFrame:
        return rows.select("query_id", F.lit(stage).alias("stage"), F.lit(kind).alias("type"), payload.alias("payload"))

    chunk = F.struct("rank", "chunk_id", "title", "source", F.round("score", 4).alias("score"), snippet("text", 200).alias("text_snippet"))
    shown = ranked.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(chunk))).alias("shown"))
    some = ranked.select("query_id").distinct()
    gated = decisions.where("grade <> 'GOOD' or web_search_used").join(some, "query_id", "left_semi")
    first = event(queries.select("query_id").join(shown, "query_id", "left"), 0, "chunk_meta", F.coalesce("shown", F.lit("[]")))
    update = event(gated, 1, "crag_update", F.to_json(F.struct("grade", "rewritten_query", "web_search_used")))
    token = event(answers, 2, "token", F.to_json(F.struct(F.col("answer").alias("text"))))
    sources = event(sources_block(ranked), 3, "sources", F.to_json(F.struct(F.col("block").alias("text"))))
    done = event(queries, 4, "done", F.lit("{}"))
    every = first.unionByName(update).unionByName(token).unionByName(sources).unionByName(done)
    seq = F.row_number().over(Window.partitionBy("query_id").orderBy("stage"))
    return every.select("query_id", seq.cast("int").alias("seq"), "type", "payload")


def sse_frame(kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))), F.lit("\n\n"))


def read_sse(frame: Column) -> Column:
    return F.from_json(F.regexp_extract(frame, r"(?s)^data: (.*?)\s*$", 1), "type string, payload string")
