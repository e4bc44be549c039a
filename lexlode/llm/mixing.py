"""Mixing sources to target shares of all tokens, by weighted sampling without replacement.

Each document draws an exponential key scaled by its quality weight (Efraimidis and
Spirakis); within a source the documents with the lowest keys come first, so better
ones are likelier to. A source's budget is its share of the total: it is used in
complete epochs as often as they fit, and the rest is taken from the front of the
key order up to the budget.

The order is never sorted as a whole: the keys of a source fall into ``BUCKETS`` ranges, the
tokens of each are added up, and the range in which the budget ends is cut into
ranges again until it holds at most ``EDGE`` documents, or documents of one key. Only these are
sorted, equal rows among them as one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlode.llm.tokens import UNIT, VOCABULARY, Counter
from lexlode.session import cut, spread

BUCKETS, EDGE = 1 << 12, 20_000
SEED = 20240101


def _size(vocabulary: str):
    def run(batches):
        count = Counter(vocabulary)
        for b in batches:
            tokens, weight = [], []
            for text in b.column(2).to_pylist():
                units = UNIT.findall(text)
                tokens.append(count.total(units))
                weight.append(quality(units))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(weight, pa.float64())], names=["id", "source", "n_tokens", "weight"])
    return run


def quality(units: list[str]) -> float:
    """Weight of a text in (0, 1]: low for short and for repetitive texts."""
    if not units:
        return 0.05
    return max(0.05, min(1.0, len(units) / 50) * min(1.0, 1.5 * len(set(units)) / len(units) + 0.25))


def _edges(keyed: DataFrame, state: DataFrame) -> DataFrame:
    """For each source the least range of keys lo to hi in which its budget ends, with the tokens before it.

    ``state``: source, rest, lo, hi, before, docs; one row per source with a budget to fill.
    Each round is one pass with an aggregate of at most BUCKETS rows a source.
    """
    state = cut(state, "mix-edges")
    while not state.where((F.col("docs") > EDGE) & (F.col("lo") < F.col("hi"))).isEmpty():
        own = F.broadcast(state.select("source", "rest", "lo", "hi", "before"))
        bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BUCKETS - 1), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))).otherwise(0)
        parts = keyed.join(own, "source").where("key between lo and hi").groupBy("source", "rest", "before", bucket.alias("bucket")).agg(
            F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("upto", F.col("before") + F.coalesce(F.sum("tokens").over(run), F.lit(0)))
        first = F.row_number().over(Window.partitionBy("source").orderBy("bucket"))
        at = parts.where(F.col("upto") + F.col("tokens") >= F.col("rest")).withColumn("first", first).where("first = 1")
        state = cut(at.select("source", "rest", "lo", "hi", F.col("upto").alias("before"), "docs"), "mix-edges")
    return state


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", seed: int = SEED, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Select documents so that each source has its target share; returns (selection, report).

    ``targets``: source, target_share, max_repeats; a fixed table, one row per source.
    Without ``total_tokens`` the total is the largest at which every source that has
    documents reaches its share within its repeats; with it, a source that runs out
    is used max_repeats times in full and falls short.
    Selection: id, source, n_tokens, times_used (1 or more). Report: one row per
    target, with target_share, available_tokens, budget_tokens, used_tokens, actual_share (of all
    used tokens), n_docs and most_repeats; a source without documents has zeros.
    The last document of a budget is used if at least half of it lies within, so a
    source misses its budget by at most half a document. Ties of keys fall to
    the lesser id, then the shorter text. Sources not listed, null sources, null ids, null texts
    and texts without tokens are not used; a row stored twice is two documents;
    shares of zero or below use nothing; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    want = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    listed = src.where("id is not null and text is not null").join(F.broadcast(want.select("source")), "source", "left_semi").select("id", "source", "text")
    kind = src.schema["id"].dataType.simpleString()
    sized = spread(listed).mapInArrow(_size(vocabulary), f"id {kind}, source string, n_tokens long, weight double").where("n_tokens > 0")
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    keyed = cut(sized.withColumn("key", -F.log(u) / F.col("weight")), "mix-keyed")

    have = cut(keyed.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("docs")), "mix-have")
    plan = want.join(have, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    able = plan.where("available_tokens > 0 and target_share > 0 and max_repeats > 0")
    total = float(total_tokens) if total_tokens is not None else able.agg(F.min(F.col("available_tokens") * F.col("max_repeats") / F.col("target_share"))).first()[0] or 0.0
    most = F.col("available_tokens") * F.col("max_repeats")
    budget = F.greatest(F.lit(0.0), F.least(F.col("target_share") * F.lit(total), most.cast("double")))
    plan = plan.withColumn("budget_tokens", F.when(F.col("available_tokens") > 0, F.round(budget).cast("long")).otherwise(F.lit(0)))
    plan = plan.withColumn("epochs", F.when(F.col("available_tokens") > 0, F.floor(F.col("budget_tokens") / F.col("available_tokens"))).otherwise(F.lit(0)).cast("int"))
    plan = cut(plan.withColumn("rest", F.col("budget_tokens") - F.col("epochs") * F.col("available_tokens")), "mix-plan")

    edge = _edges(keyed, plan.where("rest > 0").select("source", "rest", "lo", "hi", F.lit(0).cast("long").alias("before"), "docs"))
    rows = keyed.join(F.broadcast(plan.select("source", "epochs", "rest").join(edge.select("source", "lo", "hi", "before"), "source", "left")), "source")
    inside = rows.where("key < lo").select("id", "source", "n_tokens", (F.col("epochs") + 1).alias("times_used"))
    outside = rows.where("lo is null or key > hi").select("id", "source", "n_tokens", F.col("epochs").alias("times_used"))
    order = Window.partitionBy("source").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where("key between lo and hi").groupBy("source", "key", "id", "n_tokens", "epochs", "rest", "before").agg(F.count("*").alias("copies"))
    earlier = F.col("before") + F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(order), F.lit(0))
    at_edge = (
        at_edge.withColumn("earlier", earlier).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("id", "source", "n_tokens", (F.col("epochs") + (F.col("earlier") + F.col("n_tokens") * (F.col("copy") - 0.5) <= F.col("rest")).cast("int")).alias("times_used"))
    )
    chosen = inside.unionByName(at_edge).unionByName(outside).where("times_used > 0")

    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("used_tokens"), F.count("*").alias("n_docs"), F.max("times_used").alias("most_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    report = plan.join(used, "source", "left").select("source", "target_share", "available_tokens", "budget_tokens", zero("used_tokens"), zero("n_docs"), zero("most_repeats"))
    whole = report.agg(F.sum("used_tokens").alias("whole"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.round(F.when(F.col("whole") > 0, F.col("used_tokens") / F.col("whole")).otherwise(0.0), 9)).drop("whole")
    return chosen.withColumnRenamed("id", id_col), report
