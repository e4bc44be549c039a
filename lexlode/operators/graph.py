"""Entity graph: extraction, parsing of model output, building, and search by hops.

Node and edge attributes that grow with the data (the chunks that mention them)
are tables of their own, never arrays gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexlode.config import Settings
from lexlode.functions.text import fence_strip, index_terms, strip, title_case, words
from lexlode.operators.lexical import top_k
from lexlode.session import cut

# Relations that are kept, and types of entities that become nodes.
RELATIONS = (
    "author", "developer", "creator", "founded by", "owned by", "instance of", "subclass of", "part of", "has part",
    "country", "country of origin", "located in", "headquarters location", "employer", "member of", "affiliation", "educated at",
    "award received", "occupation", "field of work", "notable work", "based on", "followed by", "follows", "influenced by", "has edition",
    "product or material produced", "used by", "manufacturer", "publication date", "academic degree", "applies to jurisdiction",
    "published in", "platform", "programming language", "license",
)
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "PRODUCT", "WORK_OF_ART", "EVENT", "LAW", "NORP", "FAC", "LOC")
FEW_IDS = 500_000  # queries whose numbers are sent to every task; more are joined
SPAN = r"\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+)+"
ORG_END = r"(?i)\b(institute|university|foundation|association|company|corporation|incorporated|limited|bank|laboratories|partners|gmbh|inc|ltd)\b"


def spans(text: Column | str, chars: int = 0) -> Column:
    """Runs of capitalised words: the offline stand-in for a named-entity model. ``chars`` cuts the text, 0 takes it whole."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.substring(t, 1, chars) if chars else t, F.lit(f"({SPAN})"), F.lit(1))


def entity_type(span: Column) -> Column:
    return F.when(span.rlike(ORG_END), "ORG").otherwise("PERSON")


def chunk_entities(chunks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Distinct entities of each chunk: chunk_id, source, label, entity_type, pos of the first mention."""
    each = chunks.select("chunk_id", "source", F.posexplode(spans("text", cfg.ner_chars)).alias("pos", "span"))
    typed = each.select("chunk_id", "source", "pos", title_case(strip("span")).alias("label"), entity_type(F.col("span")).alias("entity_type"))
    kept = typed.where((F.length("label") >= 2) & F.col("entity_type").isin(*ENTITY_TYPES))
    return kept.groupBy("chunk_id", "label").agg(F.min("source").alias("source"), F.min_by("entity_type", "pos").alias("entity_type"), F.min("pos").alias("pos"))


def density(chunks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Entities per hundred tokens of each chunk: chunk_id, n_entities, n_tokens, density."""
    head = F.substring("text", 1, cfg.density_chars) if cfg.density_chars else F.col("text")
    n, tokens = F.size(spans(head)), F.size(F.filter(F.split(strip(head), r"\s+"), lambda t: t != ""))
    return chunks.select("chunk_id", n.alias("n_entities"), tokens.alias("n_tokens"), F.when(tokens > 0, n / tokens * 100).otherwise(0.0).alias("density"))


def dense_chunks(chunks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The densest fraction of the chunks above the floor of entities, at least one; of equal densities the lesser ids.

    The cut is found from counts alone: of ranges of densities, of the densities in the range
    at the cut, and of the ids' beginnings among the chunks of the density at the cut.
    Only chunks of one density and one beginning are ordered, so no task ranks a part of the table.
    """
    above = cut(density(chunks, cfg).where(F.col("n_entities") >= cfg.density_min_entities).withColumn("d", F.round("density", 9)), "graph-dense")
    total = above.count()
    keep = max(1, int(total * cfg.density_top_fraction))
    if not total:
        return above.select("chunk_id", "n_entities", "n_tokens", "density")

    def edge(rows: DataFrame, key: Column, left: int, falling: bool):
        """The value of ``key`` in which the first ``left`` rows end, and how many rows come before it."""
        sizes = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy(F.col("key").desc() if falling else F.col("key").asc()).rowsBetween(Window.unboundedPreceding, 0))
        at = sizes.withColumn("upto", upto).where(F.col("upto") >= left).orderBy("upto").first()
        return at["key"], at["upto"] - at["n"]

    coarse, head = F.floor(F.col("d") * 4), F.substring("chunk_id", 1, 4)
    span, before = edge(above, coarse, keep, True)
    inside = above.where(coarse == span)
    d, more = edge(inside, F.col("d"), keep - before, True)
    before += more
    ties = inside.where(F.col("d") == d)
    start, more = edge(ties, head, keep - before, False)
    left = keep - before - more
    last = ties.where(head == start).withColumn("r", F.row_number().over(Window.orderBy("chunk_id"))).where(F.col("r") <= left).drop("r")
    return above.where(F.col("d") > d).unionByName(ties.where(head < start)).unionByName(last).select("chunk_id", "n_entities", "n_tokens", "density")


# ---- parsers of model output ------------------------------------------------

def parse_tagged(raw: Column | str, cap: int = 8) -> Column:
    """Triples of '<triplet> S <subj> O <obj> R' output: kept relations only, title-cased ends, the first ``cap`` (0 for all)."""
    text = F.regexp_replace(raw, r"<s>|</s>|<pad>", "")
    parts = F.filter(F.split(text, "<triplet>"), lambda p: F.contains(p, F.lit("<subj>")) & F.contains(p, F.lit("<obj>")))
    cell = lambda p, i: strip(F.regexp_extract(p, r"(?s)^(.*?)<subj>(.*?)<obj>(.*)$", i))
    made = F.transform(parts, lambda p: F.struct(title_case(cell(p, 1)).alias("subject"), F.lower(cell(p, 3)).alias("predicate"), title_case(cell(p, 2)).alias("object")))
    kept = F.filter(made, lambda t: (t["subject"] != "") & (t["object"] != "") & t["predicate"].isin(*RELATIONS))
    return F.slice(kept, 1, cap) if cap else kept


def parse_json(raw: Column | str, cap: int = 5) -> Column:
    """Triples of a JSON array of objects, fenced or not: of the first ``cap`` items (0 for all) those with all three fields, a null being none."""
    text = fence_strip(raw)
    items = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>"))
    each = F.transform(F.slice(items, 1, cap) if cap else items, lambda i: F.when(F.startswith(i, F.lit("{")), F.from_json(i, "subject string, predicate string, object string")))
    made = F.transform(each, lambda t: F.struct(title_case(strip(F.coalesce(t["subject"], F.lit("")))).alias("subject"), F.lower(strip(F.coalesce(t["predicate"], F.lit("")))).alias("predicate"),
                                                title_case(strip(F.coalesce(t["object"], F.lit("")))).alias("object")))
    return F.coalesce(F.filter(made, lambda t: (t["subject"] != "") & (t["predicate"] != "") & (t["object"] != "")), F.array().cast("array<struct<subject:string,predicate:string,object:string>>"))


EXTRACTORS = {"rebel": parse_tagged, "llm": parse_json}


def extract_triples(raw: DataFrame, extractor: str, chunks: DataFrame | None = None, cfg: Settings = Settings()) -> DataFrame:
    """Triples of recorded model output (chunk_id, source, raw); '<name>-filtered' reads dense chunks only."""
    name = extractor.removesuffix("-filtered")
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {extractor!r}; known: {', '.join(sorted(EXTRACTORS))}")
    if name != extractor:
        if chunks is None:
            raise ValueError("a filtered extractor needs the chunks")
        raw = raw.join(dense_chunks(chunks, cfg).select("chunk_id"), "chunk_id", "left_semi")
    cap = cfg.json_cap if name == "llm" else cfg.tagged_cap
    each = raw.select("chunk_id", "source", F.explode(EXTRACTORS[name]("raw", cap)).alias("t"))
    return each.select("t.subject", "t.predicate", "t.object", "chunk_id", "source", F.lit(extractor).alias("extractor"))


def triples_by_rule(chunks: DataFrame) -> DataFrame:
    """Triples of neighbouring entities of a sentence: the offline stand-in for a relation model.

    The words between two capitalised spans of one sentence are their relation if they
    are one of RELATIONS, else the two are affiliated.
    """
    each = chunks.select("chunk_id", "source", F.explode(F.split("text", r"(?<=[.!?。！？।])\s+|\n")).alias("sentence"))
    found = each.withColumn("spans", spans("sentence")).where(F.size("spans") > 1)
    following = F.arrays_zip(F.slice("spans", 1, F.size("spans") - 1).alias("a"), F.slice("spans", 2, F.size("spans") - 1).alias("b"))
    pair = found.select("chunk_id", "source", "sentence", F.explode(following).alias("p"))
    exact = lambda name: F.concat(F.lit(r"\Q"), F.col(name), F.lit(r"\E"))
    before = F.element_at(F.split("sentence", exact("p.b")), 1)
    between = F.trim(F.lower(F.element_at(F.split(before, exact("p.a")), -1)))
    relation = F.when(between.isin(*RELATIONS), between).otherwise("affiliation")
    triple = pair.select(F.col("p.a").alias("subject"), relation.alias("predicate"), F.col("p.b").alias("object"), "chunk_id", "source")
    return triple.where("subject <> object")


# ---- building ---------------------------------------------------------------

def _cleaned(triples: DataFrame) -> DataFrame:
    t = triples.select(title_case(strip("subject")).alias("subject"), F.lower(strip("predicate")).alias("predicate"), title_case(strip("object")).alias("object"), "chunk_id", "source", "extractor")
    return t.where("subject <> '' and object <> '' and predicate <> ''")


def clean_triples(triples: DataFrame) -> DataFrame:
    """Triples with both ends, title-cased, lower-case predicates, repeated rows once."""
    return _cleaned(triples).distinct()


def graph_edges(triples: DataFrame) -> DataFrame:
    """Undirected edges: node_a < node_b (or equal), distinct predicates, number of chunks, first source."""
    pair = clean_triples(triples).withColumn("node_a", F.least("subject", "object")).withColumn("node_b", F.greatest("subject", "object"))
    return pair.groupBy("node_a", "node_b").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"), F.countDistinct("chunk_id").alias("n_chunks"),
                                                F.min_by("source", F.struct("chunk_id", "source")).alias("source"))


def node_pairs(triples: DataFrame) -> DataFrame:
    """The edges alone, as searches walk them: node_a, node_b."""
    return _cleaned(triples).select(F.least("subject", "object").alias("node_a"), F.greatest("subject", "object").alias("node_b")).distinct()


def edge_chunks(triples: DataFrame) -> DataFrame:
    return _cleaned(triples).where("chunk_id is not null").select(F.least("subject", "object").alias("node_a"), F.greatest("subject", "object").alias("node_b"), "chunk_id").distinct()


def node_chunks(entities: DataFrame) -> DataFrame:
    return entities.select("label", "chunk_id").distinct()


def graph_nodes(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Nodes: label, first seen entity type (UNKNOWN if only triples name it), number of chunks, first source.

    Entities come before triples; chunks are taken in the order of their ids.
    """
    seen = entities.select("label", "entity_type", "source", F.struct(F.lit(0).alias("late"), "chunk_id", "pos").alias("seq"), "chunk_id")
    ends = clean_triples(triples).select(F.explode(F.array("subject", "object")).alias("label"), F.lit("UNKNOWN").alias("entity_type"), "source",
                                         F.struct(F.lit(1).alias("late"), F.col("chunk_id"), F.lit(0).alias("pos")).alias("seq"), F.lit(None).cast("string").alias("chunk_id"))
    return seen.unionByName(ends).groupBy("label").agg(
        F.min_by("entity_type", "seq").alias("entity_type"),
        F.countDistinct("chunk_id").alias("n_chunks"),
        F.min_by("source", F.struct("seq", "source")).alias("source"))


# ---- search -----------------------------------------------------------------

def query_entities(queries: DataFrame) -> DataFrame:
    """Entities of each query: capitalised spans, else pairs of neighbouring terms; query_id, entity, pos."""
    found = F.filter(spans("query"), lambda s: F.length(s) > 1)
    t = words("query")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))
    named = F.when(F.size(found) > 0, found).otherwise(F.filter(pairs, lambda p: F.length(p) > 3))
    return queries.select("query_id", F.posexplode(F.transform(named, lambda s: title_case(strip(s)))).alias("pos", "entity"))


def _grams(col: str) -> Column:
    """Distinct runs of 3 characters of a string in small letters; of a shorter one the string itself."""
    low = F.lower(col)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substr(low, i, F.lit(3))))


def _runs(col: str) -> Column:
    """Distinct runs of one and of two characters of a string in small letters."""
    low = F.lower(col)
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    return F.array_distinct(F.concat(of(1), of(2)))


def _rarest(df: DataFrame, keys: list[str], col: str, sizes: DataFrame) -> DataFrame:
    """Each string with the one of its runs that fewest labels hold; strings with a run that none holds are left out."""
    each = df.select(*keys, F.explode(_grams(col)).alias("gram")).join(sizes, "gram", "left")
    best = each.groupBy(*keys).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("strange"))
    return best.where("strange = 0").drop("strange")


def anchor_nodes(entities: DataFrame, nodes: DataFrame, most: int = 10) -> DataFrame:
    """Nodes that queries start from: query_id, label; at most ``most`` per query.

    An entity equal to a label (case aside) anchors there. Otherwise every label that
    holds it or is held by it does. Such pairs share all runs of three characters of the shorter
    string, and meet on the one that fewest labels hold, so a frequent run is no hot key.
    Entities and labels of fewer than three characters meet on themselves and on runs of their length.
    """
    labels = nodes.select("label", F.lower("label").alias("key")).where("key <> ''")
    asked = entities.where("entity <> ''").withColumn("key", F.lower("entity"))
    exact = asked.join(labels, "key").select("query_id", "pos", "entity", "label")
    rest = asked.join(exact.select("query_id", "entity").distinct(), ["query_id", "entity"], "left_anti").drop("key")
    names = labels.select("label")
    short = lambda c: F.length(c) < 3
    names_of, rest = rest, rest.select("entity").distinct()
    keys, pair = ["entity"], ["entity", "label"]
    of_labels = names.where(~short("label")).select("label", F.explode(_grams("label")).alias("gram"))
    sizes = of_labels.groupBy("gram").agg(F.count("*").alias("n"))
    rare_entity = _rarest(rest.where(~short("entity")).select(*keys), keys, "entity", sizes)
    rare_label = _rarest(names.where(~short("label")), ["label"], "label", sizes)
    of_entities = rest.where(~short("entity")).select(*keys, F.explode(_grams("entity")).alias("gram"))
    longer = rare_entity.join(of_labels, "gram").where(F.contains(F.lower("label"), F.lower("entity"))).select(*pair)
    shorter = of_entities.join(rare_label, "gram").where(F.contains(F.lower("entity"), F.lower("label"))).select(*pair)
    in_labels = names.select("label", F.explode(_runs("label")).alias("gram")).join(rest.where(short("entity")).withColumn("gram", F.lower("entity")), "gram").select(*pair)
    in_entities = rest.select(*keys, F.explode(_runs("entity")).alias("gram")).join(names.where(short("label")).withColumn("gram", F.lower("label")), "gram").select(*pair)
    held = names_of.join(longer.unionByName(shorter).unionByName(in_labels).unionByName(in_entities), "entity").select("query_id", "pos", "entity", "label")
    hits = exact.withColumn("late", F.lit(0)).unionByName(held.withColumn("late", F.lit(1)))
    first = hits.groupBy("query_id", "label").agg(F.min(F.struct("pos", "late")).alias("seq"))
    w = Window.partitionBy("query_id").orderBy("seq", "label")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query_id", "label", "rank")


def _numbered(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with a number of their own: ``key``, block, bit. A block has 64 of them, one for each bit of a long."""
    each = keys.select(key).distinct()
    parts = each.count() // 100_000 + 1
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    n = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return each.withColumn("part", part).withColumn("n", n).select(key, (F.col("part") * 1_000_000 + F.floor(F.col("n") / 64)).alias("block"), (F.col("n") % 64).cast("int").alias("bit"))


def _sets(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with the number of their set of anchors (query_id, block, bit), and where the sets start (block, label, mask).

    Queries with the same anchors reach the same nodes, so each set is searched once.
    """
    of_query = cut(anchors.groupBy("query_id").agg(F.array_sort(F.collect_set("label")).alias("labels")), "graph-sets")
    numbers = cut(_numbered(of_query, "labels"), "graph-numbers")
    starts = numbers.select("block", F.explode("labels").alias("label"), F.expr("shiftleft(1L, bit)").alias("mask"))
    return of_query.join(numbers, "labels").select("query_id", "block", "bit"), starts.groupBy("block", "label").agg(F.bit_or("mask").alias("mask"))


def _by_query(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of sets (block, bit) as rows of their queries."""
    ids = cut(ids, "graph-ids")
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, ["block", "bit"]).drop("block", "bit")


def _bits(rows: DataFrame) -> DataFrame:
    """A row for each bit of ``mask``."""
    cols = [c for c in rows.columns if c != "mask"]
    return rows.select(*cols, F.expr("explode(filter(sequence(0, 63), i -> getbit(mask, i) = 1))").alias("bit"))


def _levels(starts: DataFrame, edges: DataFrame, most: int, full: DataFrame | None = None) -> list[DataFrame]:
    """Nodes at each distance from the sets of anchors: block, label, mask of the sets, distance.

    All sets of a block walk at once: an edge carries their mask, so what is shuffled follows the edges and
    the blocks, not the pairs of query and node. Sets that have reached a label of ``full`` go no farther.
    """
    both = edges.select(F.col("node_a").alias("label"), F.col("node_b").alias("next")).unionByName(edges.select(F.col("node_b").alias("label"), F.col("node_a").alias("next"))).where("label <> next")
    levels = [cut(starts.select("block", "label", "mask", F.lit(0).alias("distance")), "graph-hops")]
    ended: DataFrame | None = None
    for d in range(1, most + 1):
        front = levels[-1]
        if full is not None:
            now = front.join(full, "label", "left_semi").select("block", "mask")
            ended = cut((now if ended is None else now.unionByName(ended)).groupBy("block").agg(F.bit_or("mask").alias("mask")), "graph-ended")
            front = front.join(ended.withColumnRenamed("mask", "ended"), "block", "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("ended", F.lit(0).cast("long"))))).where("mask <> 0")
        rows = front.join(both, "label").select("block", F.col("next").alias("label"), F.col("mask").alias("new"), F.lit(0).cast("long").alias("old"))
        for seen in levels:
            rows = rows.unionByName(seen.select("block", "label", F.lit(0).cast("long").alias("new"), F.col("mask").alias("old")))
        merged = rows.groupBy("block", "label").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = merged.select("block", "label", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("mask"), F.lit(d).alias("distance")).where("mask <> 0")
        levels.append(cut(fresh, "graph-hops"))
    return levels


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def search_from(anchors: DataFrame, edges: DataFrame, of_nodes: DataFrame, of_edges: DataFrame, k: int, most: int = 2) -> DataFrame:
    """Best ``k`` chunks of every query by its anchors: query_id, chunk_id, score, rank.

    Once a node at some distance has ``k`` chunks of its own, nothing that scores less can be
    among the best, so the walk of its set ends there.
    """
    ids, starts = _sets(anchors)
    lists = _lists(of_nodes, of_edges, k)
    full = lists.where("side = 0").groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("label")
    hits = _best(_union(_levels(starts, edges, most, full)), lists, k, most)
    return _by_query(hits, ids).select("query_id", "chunk_id", "score", "rank")


def hops(anchors: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """Distance of every node within ``most`` hops of a query's anchors: query_id, label, distance."""
    ids, starts = _sets(anchors)
    return _by_query(_bits(_union(_levels(starts, edges, most))), ids).select("query_id", "label", "distance")


def _lists(of_nodes: DataFrame, of_edges: DataFrame, k: int) -> DataFrame:
    """The chunks of nodes (side 0) and of the edges that end at them (side 1): label, chunk_id, side; the first ``k`` ids of each.

    All chunks of one list score the same and ties go to the lesser id, so a chunk behind ``k`` others of its
    list is not among the best ``k`` of any query.
    """
    ends = of_edges.select(F.explode(F.array("node_a", "node_b")).alias("label"), "chunk_id")
    both = of_nodes.select("label", "chunk_id", F.lit(0).alias("side")).unionByName(ends.withColumn("side", F.lit(1)))
    place = F.dense_rank().over(Window.partitionBy("label", "side").orderBy("chunk_id"))
    return cut(both.withColumn("place", place).where(F.col("place") <= k).drop("place").distinct(), "graph-lists")


def _best(reached: DataFrame, lists: DataFrame, k: int, most: int) -> DataFrame:
    """Best ``k`` chunks of each set by hops: block, bit, chunk_id, score, rank. A node scores 2^-d, an edge 0.8 * 2^-d of its nearer end."""
    rows = reached.join(lists, "label")
    kinds = [(f"m{d}_{side}", d, side, (0.8 if side else 1.0) * 0.5**d) for d in range(most + 1) for side in (0, 1)]  # best scores first
    none = F.lit(0).cast("long")
    masks = rows.groupBy("block", "chunk_id").agg(*(F.bit_or(F.when((F.col("distance") == d) & (F.col("side") == side), F.col("mask")).otherwise(none)).alias(name) for name, d, side, _ in kinds))
    taken, each = none, []
    for name, _, _, score in kinds:
        each.append(F.struct(F.lit(score).alias("score"), F.col(name).bitwiseAND(F.bitwise_not(taken)).alias("mask")))
        taken = taken.bitwiseOR(F.col(name))
    scored = masks.select("block", "chunk_id", F.explode(F.array(*each)).alias("s")).select("block", "chunk_id", "s.score", "s.mask").where("mask <> 0")
    return top_k(_bits(scored), "score", k, ["block", "bit"])


def graph_search(reached: DataFrame, edges: DataFrame, of_nodes: DataFrame, of_edges: DataFrame, k: int) -> DataFrame:
    """Best chunks by hops that were walked before: a node scores 2^-d, an edge 0.8 * 2^-d of its nearer end; query_id, chunk_id, score, rank."""
    ids = cut(_numbered(reached, "query_id"), "graph-numbers")
    masks = reached.join(ids, "query_id").groupBy("block", "label", "distance").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    most = reached.agg(F.max("distance")).first()[0] or 0
    return _by_query(_best(masks, _lists(of_nodes, of_edges.join(edges.select("node_a", "node_b").distinct(), ["node_a", "node_b"], "left_semi"), k), k, most), ids).select("query_id", "chunk_id", "score", "rank")
