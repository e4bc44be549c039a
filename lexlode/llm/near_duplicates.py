"""Near-duplicate documents: banded MinHash candidates, Bayesian pruning, exact verification.

1. Each text is normalised and its distinct character shingles are hashed; the
   least hash of each of ``BINS`` bins of one permutation is its signature. A bin
   that a short text leaves empty takes the least hash of a permutation of its own.
2. Exact copies (same normalised text) collapse to one representative.
3. Representatives that share a band of ``ROWS`` signature values are candidates.
4. Signatures of a candidate pair are compared ``STEP`` values at a time; the pair
   is dropped as soon as the posterior probability that its similarity reaches
   the threshold falls below ``TOLERANCE``.
5. The remaining pairs are verified on their exact shingle sets.

Bands are chosen so that a pair exactly at similarity 0.7 shares one with
probability 0.9999 and a pair at 0.8 with all but certainty. A bucket with more
than ``HOT`` representatives is split into blocks that are compared pairwise in
separate tasks; only pairs that survive the pruning leave a task.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlode.llm.shingles import hashes, mix, normal, pieces, shingle_set
from lexlode.operators.components import connected_components
from lexlode.session import cut, spread

BINS, ROWS, STEP, TOLERANCE, HOT = 256, 5, 32, 1e-6, 400
BANDS = BINS // ROWS
_CHARS = 1_000_000
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_OWN = mix(np.arange(BANDS + 1, BANDS + BINS + 1, dtype=np.uint64))


def signatures(texts: list[str], width: int) -> np.ndarray:
    """One-permutation MinHash of normalised texts: 8 bits for each of BINS bins.

    Unequal values agree by chance once in 256, which can only keep a pair longer.

    An empty bin takes the least value of all shingles under the bin's own permutation,
    so that each value of two texts agrees with the probability of their similarity and
    none repeats another, however few shingles there are. Empty texts get zeros.
    """
    out = np.zeros((len(texts), BINS), dtype=np.uint8)
    for first, last in pieces(texts, _CHARS):
        part = [t if len(t) >= width else t.ljust(width, "\0") for t in texts[first:last]]
        sizes = np.array([len(t) for t in part])
        h = hashes("".join(part), width)
        owner = np.repeat(np.arange(len(part)), sizes)[: len(h)]
        offset = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)[: len(h)]
        keep = offset <= (sizes - width)[owner]
        h, owner = h[keep], owner[keep]
        full = np.full(len(part) * BINS, np.iinfo(np.uint32).max, dtype=np.uint32)
        np.minimum.at(full, owner * BINS + (h >> np.uint64(56)).astype(np.int64), (h >> np.uint64(20)).astype(np.uint32) >> np.uint32(1))
        full = full.reshape(len(part), BINS)
        empty = full == np.iinfo(np.uint32).max
        ends = np.searchsorted(owner, np.arange(len(part) + 1))
        for i in np.flatnonzero(empty.any(axis=1)):
            own = np.unique(h[ends[i] : ends[i + 1]])
            holes = np.flatnonzero(empty[i])
            for some in np.array_split(holes, 1 + len(own) * len(holes) // _CHARS):
                full[i, some] = (mix(own ^ _OWN[some, None]).min(axis=1) >> np.uint64(32)).astype(np.uint32)
        out[first:last] = (full * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    for i, t in enumerate(texts):
        if not t:
            out[i] = 0
    return out


@lru_cache(maxsize=64)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) is the probability
    that a binomial of n + 1 trials with success t gives at most m.
    """
    out = []
    for n in range(STEP, BINS + 1, STEP):
        total, m = 0.0, 0
        for m in range(n + 2):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of two aligned signature matrices stay possible pairs."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        span = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (a[alive, span] == b[alive, span]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _matrix(column) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(-1, BINS)


def _sign(width: int):
    def run(batches):
        for b in batches:
            texts = [normal(t) for t in b.column(1).to_pylist()]
            keep = [i for i, t in enumerate(texts) if t]
            sig = signatures([texts[i] for i in keep], width)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())),
                 pa.array([xxhash.xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in keep], pa.binary()),
                 pa.array([s.tobytes() for s in sig], pa.binary())],
                names=["id", "digest", "sig"],
            )
    return run


def _bands(batches):
    for b in batches:
        m = _matrix(b.column(1)).astype(np.uint64)
        keys = np.empty((len(m), BANDS), dtype=np.uint64)
        for k in range(BANDS):
            h = np.full(len(m), _SALT[k])
            for r in range(ROWS):
                h = mix(h + m[:, k * ROWS + r])
            keys[:, k] = h
        ids = b.column(0).take(pa.array(np.repeat(np.arange(len(m)), BANDS)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), ids], names=["key", "id"])


def _prune(threshold: float, tolerance: float):
    def run(batches):
        for b in batches:
            if b.num_rows:
                ok = survives(_matrix(b.column(2)), _matrix(b.column(3)), threshold, tolerance)
                yield b.select(["a", "b"]).filter(pa.array(ok))
    return run


def _block_pairs(threshold: float, tolerance: float):
    """Pairs of one or two blocks of a hot bucket that survive the pruning."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, ids, m = np.asarray(t["side"]), t["id"].combine_chunks(), _matrix(t["sig"])
        order = np.asarray(pc.rank(ids, tiebreaker="first"))
        left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        low, high = [], []
        for i in left:
            js = right[order[right] > order[i]] if side[0] == 0 else right
            js = js[survives(np.broadcast_to(m[i], (len(js), BINS)), m[js], threshold, tolerance)]
            first = order[js] > order[i]
            low.append(np.where(first, i, js))
            high.append(np.where(first, js, i))
        take = lambda at: ids.take(pa.array(np.concatenate(at) if at else np.empty(0, dtype=np.int64)))
        return pa.table({"a": take(low), "b": take(high)})
    return run


def _verify(width: int, threshold: float):
    def run(batches):
        last, left = None, None
        for b in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if x is not last:
                    last, left = x, shingle_set(normal(x), width)
                right = shingle_set(normal(y), width)
                common = len(np.intersect1d(left, right, assume_unique=True))
                sim = common / max(1, len(left) + len(right) - common)
                if sim >= threshold:
                    keep.append(i)
                    sims.append(sim)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)), pa.array(sims, pa.float64())],
                names=["a", "b", "similarity"],
            )
    return run


class NearDuplicates:
    """Links between the distinct texts of a table and the copies of each.

    ``members``: id, rep – every row with a text, and the least id with the same
    normalised text. ``links``: a < b, similarity – every pair of representatives
    alike by at least ``threshold``.
    """

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """All pairs a < b of rows that are alike, copies included."""
        m = self.members
        x, y = (m.select(F.col("rep").alias(k), F.col("id").alias(f"id_{k}")) for k in ("a", "b"))
        linked = self.links.select("a", "b").join(x, "a").join(y, "b").select("id_a", "id_b")
        again = m.groupBy("rep").count().where("count > 1").select("rep")
        same = m.join(again, "rep", "left_semi")
        copies = same.select("rep", F.col("id").alias("id_a")).join(same.select("rep", F.col("id").alias("id_b")), "rep").where("id_a < id_b")
        return linked.unionByName(copies.select("id_a", "id_b")).select(
            F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))

    def classes(self) -> DataFrame:
        """One row per row of the table with a text: id, class_id, number of links of its text."""
        comp = connected_components(self.links)
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
        return (
            self.members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").join(ends, "rep", "left")
            .select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 9,
                    threshold: float = 0.7, tolerance: float = TOLERANCE) -> NearDuplicates:
    """Find the links between near-equal texts of ``docs``.

    Rows with a null id, a null text or nothing but white space have no shingle and
    take no part; texts shorter than ``width`` are alike only to equal ones; a
    repeated id counts as one more copy; other columns, whatever their names, are
    not read. Ids may be of any orderable type. An empty table gives empty results.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = src.schema["id"].dataType.simpleString()
    signed = cut(spread(src).mapInArrow(_sign(width), f"id {kind}, digest binary, sig binary"), "dup-signed")
    reps = cut(signed.groupBy("digest").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "dup-reps")
    members = signed.select("id", "digest").join(reps.select("digest", "rep"), "digest").select("id", "rep").distinct()

    bands = reps.select("rep", "sig").mapInArrow(_bands, f"key long, id {kind}")
    w = Window.partitionBy("key")
    shared = cut(bands.withColumn("n", F.count("*").over(w)).where("n > 1"), "dup-bands")
    x = shared.where(F.col("n") <= HOT).select("key", F.col("id").alias("a"))
    near = x.join(x.select("key", F.col("a").alias("b")), "key").where("a < b").select("a", "b").distinct()
    sig = reps.select("rep", "sig")
    pruned = (
        near.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(threshold, tolerance), f"a {kind}, b {kind}")
    )
    hot = shared.where(F.col("n") > HOT)
    blocks = F.ceil(F.col("n") / HOT).cast("int")
    own = hot.join(sig.withColumnRenamed("rep", "id"), "id").withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "id", "sig")
    from_hot = placed.groupBy("key", "bi", "bj").applyInArrow(_block_pairs(threshold, tolerance), f"a {kind}, b {kind}")
    possible = cut(pruned.unionByName(from_hot).distinct(), "dup-possible")

    needed = cut(possible.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "dup-needed")
    texts = cut(src.join(needed, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "dup-texts")
    links = cut(
        possible.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b").mapInArrow(_verify(width, threshold), f"a {kind}, b {kind}, similarity double"),
        "dup-links",
    )
    return NearDuplicates(members, links)
