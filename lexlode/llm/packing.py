"""Filling containers of fixed capacity with whole texts that belong together.

1. One pass over the texts counts tokens and distinct hashed terms, and gives each
   text a code: the signs of its idf-weighted term vector, hashed to ``DIMS`` numbers, along
   the main directions of a bounded sample. Texts alike share long beginnings of their codes.
2. Codes are counted and cut into ranges of at most about ``SHARD_TOKENS`` tokens and
   ``SHARD_TEXTS`` texts, the shards; a code with more than that (copies, a hot topic) is
   split by a hash of the text. Neither file splits nor the number of cores matter.
3. A shard has a BM25 inverted index of its texts. The largest unused text seeds a
   container; the index ranks the unused texts by their likeness to it, and the best
   that fit are added until nothing does; where only one more fits, the largest is taken.
   Texts longer than a container give full pieces of their own, and a rest that is
   packed like a text.

Only counts and terms are shuffled, once, never the texts.
"""

from __future__ import annotations

import re
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlode.llm.sampling import hashed_sample
from lexlode.llm.tokens import UNIT, VOCABULARY, Counter
from lexlode.session import cut, spread

SHARD_TOKENS, SHARD_TEXTS, K1, B = 700_000, 1200, 1.2, 0.75
SAMPLE_TEXTS, DIMS, BITS, FINER, LOCAL = 4000, 512, 24, 3, 12
ORDINAL, SALT = 22, 17
_WIDE = re.compile("[฀-๿⺀-鿿぀-ヿ]")
_TRIM = re.compile(r"^\W+|\W+$")


class Terms:
    """Hashes of the terms of units, remembered; a unit without spaces of its own script gives its character pairs."""

    def __init__(self):
        self.units: dict[str, tuple[int, ...]] = {}

    def of(self, unit: str) -> tuple[int, ...]:
        t = _TRIM.sub("", unit).lower()
        terms = [t[i : i + 2] for i in range(len(t) - 1)] if _WIDE.search(t) else [t] if t else []
        got = tuple(xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in terms)
        if len(unit) < 64:
            if len(self.units) > 400_000:
                self.units.clear()
            self.units[unit] = got
        return got

    def vector(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term hashes and their counts."""
        known, all_ = self.units, []
        for u in units:
            got = known.get(u)
            all_ += self.of(u) if got is None else got
        return np.unique(np.array(all_, dtype=np.uint32), return_counts=True)


# ---- codes ------------------------------------------------------------------

def weighted(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector of DIMS numbers: idf-weighted terms, each added to or taken from the number it hashes to."""
    sign = 1.0 - 2.0 * ((terms >> np.uint32(31)) & 1)
    v = np.bincount((terms % DIMS).astype(np.int64), weights=sign * np.log1p(counts) * idf[(terms >> np.uint32(9)) % len(idf)], minlength=DIMS)
    return v / max(1e-12, np.sqrt(v @ v))


def _vectors(batches):
    """Term vectors of a sample."""
    own = Terms()
    for b in batches:
        got = [own.vector(UNIT.findall(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tobytes() for t, _ in got], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in got], pa.binary())], names=["id", "terms", "counts"])


def directions(sample: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """idf of hashed terms, main directions of the sample and the medians along them."""
    df = np.zeros(1 << 16)
    for t, _ in sample:
        df[np.unique((t >> np.uint32(9)) % len(df))] += 1
    idf = np.log1p((len(sample) - df + 0.5) / (df + 0.5))
    if len(sample) < 2:
        return idf, np.zeros((BITS, DIMS)), np.zeros(BITS)
    x = np.array([weighted(t, c, idf) for t, c in sample])
    main = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:BITS]
    main = np.vstack([main, np.zeros((BITS - len(main), DIMS))])
    return idf, main, np.median(x @ main.T, axis=0)


def _measure(vocabulary: str, idf: np.ndarray, main: np.ndarray, middle: np.ndarray):
    """Tokens, code and terms of each text."""
    powers = 1 << np.arange(BITS - 1, -1, -1)

    def run(batches):
        count, own = Counter(vocabulary), Terms()
        for b in batches:
            sizes, codes, terms, counts, digests = [], [], [], [], []
            for text in b.column(1).to_pylist():
                units = UNIT.findall(text)
                sizes.append(count.total(units))
                t, c = own.vector(units)
                codes.append(int(((main @ weighted(t, c, idf)) > middle) @ powers))
                terms.append(t.tobytes())
                counts.append(np.minimum(c, 65_535).astype(np.uint16).tobytes())
                digests.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(codes, pa.int32()), pa.array(digests, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                names=["id", "n_tokens", "code", "digest", "terms", "counts"])
    return run


def placed(measured: DataFrame) -> DataFrame:
    """Rows of ``measured`` with their shard, a number that is the same whatever the layout."""
    n, tokens = measured.agg(F.count("*"), F.sum("n_tokens")).first()
    wanted = max(1.0, (tokens or 0) / SHARD_TOKENS, n / SHARD_TEXTS)
    bits = min(BITS, max(0, ceil(log2(wanted))) + FINER)
    rows = measured.withColumn("range", F.shiftright("code", BITS - bits))
    sizes = rows.groupBy("range").agg((F.greatest(F.sum("n_tokens") / SHARD_TOKENS, F.count("*") / SHARD_TEXTS)).alias("load"), F.count("*").alias("texts"))
    # ranges that follow each other share a shard until it is full; runs are summed apart for each 2^LOCAL ranges
    block = F.shiftright("range", LOCAL)
    run = Window.partitionBy("block", "large").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    each = sizes.withColumns({"block": block, "large": F.col("load") >= 1}).withColumn("before", F.coalesce(F.sum("load").over(run), F.lit(0.0)))
    group = Window.partitionBy("block", "large", F.when(F.col("large"), F.col("range")).otherwise(F.floor("before")))
    parts = F.ceil(F.when(F.col("large"), F.col("load")).otherwise(1.0)).cast("int")
    shards = cut(each.withColumn("first", F.min("range").over(group)).select("range", "texts", "first", parts.alias("parts")), "packing-shards")
    hot = shards.where(F.col("texts") * 1000 > n)  # fewer than 1000 rows
    place = ["range", "first", "parts"]
    in_hot = rows.join(F.broadcast(hot.select(*place)), "range")
    others = rows.join(F.broadcast(hot.select("range")), "range", "left_anti")
    joined = in_hot.unionByName(others.join(shards.where(F.col("texts") * 1000 <= n).select(*place), "range"))
    number = F.shiftleft(F.shiftleft(F.col("first").cast("long"), SALT) + F.pmod(F.col("digest"), F.col("parts").cast("long")), ORDINAL)
    return joined.select(number.alias("shard"), "id", "n_tokens", "digest", "terms", "counts")


# ---- packing ----------------------------------------------------------------

class Index:
    """BM25 postings of the texts of one shard."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.query = [v[0] for v in vectors]
        n = len(vectors)
        lengths = np.array([v[1].sum() for v in vectors], dtype=float)
        doc = np.repeat(np.arange(n), [len(v[0]) for v in vectors])
        term = np.concatenate([v[0] for v in vectors]) if n else np.empty(0, dtype=np.int64)
        tf = np.concatenate([v[1] for v in vectors]).astype(float) if n else np.empty(0)
        order = np.argsort(term, kind="stable")
        df = np.bincount(term, minlength=n_terms)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if n else 1.0))
        self.doc = doc[order].astype(np.int32)
        self.weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc]))[order].astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(df)])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of each text of the shard for the terms of one of them."""
        q = self.query[seed]
        lo, n = self.start[q], self.start[q + 1] - self.start[q]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(q) else np.empty(0, dtype=np.int64)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill(sizes: np.ndarray, owner: np.ndarray, index: Index, capacity: int) -> list[list[int]]:
    """Groups of items, each within ``capacity``; ``owner`` gives the text of an item in the index."""
    groups: list[list[int]] = []
    order = np.argsort(-sizes, kind="stable")
    used = np.zeros(len(sizes), dtype=bool)
    by_size = order[::-1]
    for seed in order:
        if used[seed]:
            continue
        used[seed] = True
        group, room = [int(seed)], capacity - int(sizes[seed])
        free = by_size[~used[by_size]]
        free = free[: np.searchsorted(sizes[free], room, side="right")]
        if len(free):
            rank = index.scores(int(owner[seed]))[owner[free]]
            while len(free):
                pick = int(rank.argmax())
                if room - sizes[free[pick]] < sizes[free[0]]:
                    pick = len(free) - 1
                item = int(free[pick])
                group.append(item)
                used[item] = True
                room -= int(sizes[item])
                keep = np.ones(len(free), dtype=bool)
                keep[pick] = False
                keep[np.searchsorted(sizes[free], room, side="right"):] = False
                free, rank = free[keep], rank[keep]
        groups.append(group)
    return groups


def numbered(vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """The vectors with the terms of a shard numbered from 0, and the number of terms."""
    if not vectors:
        return [], 0
    names, number = np.unique(np.concatenate([t for t, _ in vectors]), return_inverse=True)
    at = np.cumsum([0] + [len(t) for t, _ in vectors])
    return [(number[lo:hi], c) for lo, hi, (_, c) in zip(at, at[1:], vectors)], len(names)


def pack_shard(sizes: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], capacities: list[tuple[str, int]]) -> list[tuple]:
    """Rows (kind, container, position, text, start token, tokens) of one shard; containers are numbered from 0."""
    index = Index(*numbered(vectors))
    rows: list[tuple] = []
    start = 0
    for kind, capacity in capacities:
        item_size, owner, offset = [], [], []
        for d, n in enumerate(sizes):
            full = n // capacity if n > capacity else 0
            for k in range(full):
                rows.append((kind, start, 0, d, k * capacity, capacity))
                start += 1
            if n > full * capacity or n == 0:
                item_size.append(n - full * capacity)
                owner.append(d)
                offset.append(full * capacity)
        for group in fill(np.array(item_size, dtype=np.int64), np.array(owner, dtype=np.int64), index, capacity):
            rows += [(kind, start, pos, owner[i], offset[i], item_size[i]) for pos, i in enumerate(group)]
            start += 1
    return rows


def _pack(capacities: list[tuple[str, int]]):
    def run(batches):
        now, ids, sizes, vectors = None, [], [], []

        def out():
            rows = pack_shard(sizes, vectors, capacities)
            all_ids = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([now + r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()),
                 all_ids.take(pa.array([r[3] for r in rows], pa.int64())), pa.array([r[4] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.int64())],
                names=["container_kind", "container_id", "position", "id", "start_token", "n_tokens"])

        for b in batches:
            first, shards = 0, b.column("shard").to_pylist()
            rows = zip(shards, b.column("n_tokens").to_pylist(), b.column("terms").to_pylist(), b.column("counts").to_pylist())
            for i, (shard, n, terms, counts) in enumerate(rows):
                if shard != now:
                    if i > first:
                        ids.append(b.column("id").slice(first, i - first))
                    if sizes:
                        yield out()
                    now, ids, sizes, vectors, first = shard, [], [], [], i
                sizes.append(n)
                vectors.append((np.frombuffer(terms, dtype=np.uint32), np.frombuffer(counts, dtype=np.uint16).astype(np.int64)))
            if len(shards) > first:
                ids.append(b.column("id").slice(first))
        if sizes:
            yield out()
    return run


def pack_texts(docs: DataFrame, capacities: list[tuple[str, int]], id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
               sample: int = SAMPLE_TEXTS) -> DataFrame:
    """Contents of containers: container_kind, container_id, position, id, start_token, n_tokens.

    ``capacities``: (kind, tokens) pairs; the texts are packed once for each. Every row
    with a text is placed exactly once per kind: whole if it fits, else as full
    pieces and a rest that follow each other. Containers never hold more than their
    capacity. Empty texts take no room, null texts are left out, repeated rows are
    packed again, ids may be null, other columns are not read, an empty table gives
    an empty result. The main directions of the codes are fitted on about ``sample`` texts,
    those whose ids hash lowest; every text is coded and indexed. The result does not depend on the
    layout of the files, unless rows of equal id and text change places.
    """
    if not capacities or any(c <= 0 for _, c in capacities):
        raise ValueError("each container needs a capacity above 0")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = src.schema["id"].dataType.simpleString()
    some = hashed_sample(src, "id", sample).mapInArrow(_vectors, f"id {kind}, terms binary, counts binary").orderBy("id", "terms").select("terms", "counts").collect()
    idf, main, middle = directions([(np.frombuffer(r.terms, dtype=np.uint32), np.frombuffer(r.counts, dtype=np.uint32)) for r in some])
    measured = cut(spread(src).mapInArrow(_measure(vocabulary, idf, main, middle), f"id {kind}, n_tokens long, code int, digest long, terms binary, counts binary"), "packing-measured")
    order = ["shard", "digest", "id"]
    return (
        placed(measured).repartition("shard").sortWithinPartitions(*order)
        .mapInArrow(_pack(capacities), f"container_kind string, container_id long, position int, id {kind}, start_token long, n_tokens long").withColumnRenamed("id", id_col)
    )


def fill_report(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """Per kind: number of containers, tokens held, and the share of all room that is used."""
    room = F.create_map(*(F.lit(x) for pair in capacities for x in pair))
    each = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n"))
    return each.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens")).withColumn(
        "used_share", F.round(F.col("tokens") / (F.col("containers") * room[F.col("container_kind")]), 6))
