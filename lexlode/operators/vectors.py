"""Exact and clustered nearest-neighbour search over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexlode.operators.lexical import top_k

BLOCK, FEW_QUERIES, PART_VECTORS, CELLS = 512, 4096, 100_000, 4_000_000


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; all lists have one length."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _order(ids: pa.Array) -> np.ndarray:
    """The place of each id among all of them, the least first."""
    out = np.empty(len(ids), dtype=np.int64)
    out[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
    return out


def _best(sim: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of each row, ties to 9 decimals included; of equal entries the k first by ``order``."""
    n = min(k, sim.shape[1])
    if n == sim.shape[1]:
        return np.repeat(np.arange(len(sim)), n), np.tile(np.arange(n), len(sim))
    floor = -np.partition(-sim, n - 1, axis=1)[:, n - 1 : n]
    who, at = np.nonzero(sim >= floor - 2e-9)
    if len(who) <= 2 * n * len(sim):
        return who, at
    value = sim[who, at]
    by = np.lexsort((order[at], value, who))
    who, at, value = who[by], at[by], value[by]
    first = np.flatnonzero(np.r_[True, (np.diff(who) != 0) | (np.diff(value) != 0)])
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    return who[place < n], at[place < n]


def _hits(who: np.ndarray, at: np.ndarray, sim: np.ndarray, ids: pa.Array, vec_ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(who)), vec_ids.take(pa.array(at)), pa.array(sim[who, at], pa.float64())], names=["query_id", "vec_id", "score"])


def _scan(ids: pa.Array, queries: np.ndarray, k: int, block: int, cells: tuple[np.ndarray, np.ndarray] | None = None):
    """The best k of each batch for each query, one matrix product per block of queries; with cells, only of those a query visits."""
    q = unit(queries)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            v, vec_ids = unit(matrix(b.column("embedding"))), b.column("vec_id")
            order = _order(vec_ids)
            own = np.asarray(b.column("cell")) if cells is not None else np.zeros(len(v), dtype=int)
            for c in np.unique(own):
                rows = np.flatnonzero(own == c)
                asked = np.arange(len(q)) if cells is None else np.flatnonzero((cells[1] == c).any(axis=1))
                step = max(1, min(block, CELLS // len(rows)))
                for first in range(0, len(asked), step):
                    mine = asked[first : first + step]
                    sim = q[mine] @ v[rows].T
                    who, at = _best(sim, k, order[rows])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(mine[who])), vec_ids.take(pa.array(rows[at])), pa.array(sim[who, at], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _meet(k: int, block: int):
    """The best k of each part of the vectors for each query: a part's vectors come first, then the queries, all of them or those of its cell."""
    def run(batches: Iterator[pa.RecordBatch]):
        now, held, v, vec_ids, order = None, [], None, None, None
        for b in batches:
            parts, sides = np.asarray(b.column("part")), np.asarray(b.column("side"))
            edges = np.flatnonzero((np.diff(parts) != 0) | (np.diff(sides) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(parts)]):
                if hi == lo:
                    continue
                if parts[lo] != now:
                    now, held, v = parts[lo], [], None
                some = b.slice(lo, hi - lo)
                if sides[lo] == 0:
                    held.append(some)
                    continue
                if not held:
                    continue
                if v is None:
                    v = np.vstack([unit(matrix(h.column("embedding"))) for h in held])
                    vec_ids = pa.concat_arrays([h.column("vec_id") for h in held])
                    order = _order(vec_ids)
                step = max(1, min(block, CELLS // len(v)))
                for first in range(0, some.num_rows, step):
                    q = some.slice(first, step)
                    sim = unit(matrix(q.column("embedding"))) @ v.T
                    who, at = _best(sim, k, order)
                    yield _hits(who, at, sim, q.column("query_id"), vec_ids)

    return run


def _pairs(asked: DataFrame, base: DataFrame, k: int, block: int, probes=None, few: int = FEW_QUERIES, part: int = PART_VECTORS) -> DataFrame:
    """Best hits of each part of ``base`` (vec_id, embedding, and cell if ``probes`` gives the cells that queries visit).

    Up to ``few`` queries are sent to one scan of the vectors. More of them are copied to
    every part of at most about ``part`` vectors that they visit, where they stream past the part's matrix:
    the vectors are shuffled once however many queries there are.
    """
    qk, vk = asked.schema["query_id"].dataType.simpleString(), base.schema["vec_id"].dataType.simpleString()
    out = f"query_id {qk}, vec_id {vk}, score double"
    first = asked.limit(few + 1).toArrow()
    if first.num_rows == 0:
        return base.sparkSession.createDataFrame([], out)
    if first.num_rows <= few:
        ids, q = first.column("query_id").combine_chunks(), matrix(first.column("embedding"))
        cells = None if probes is None else (None, probes(q))
        if cells is not None:  # only the folders of visited cells are read
            base = base.where(F.col("cell").isin([int(c) for c in np.unique(cells[1])]))
        return base.mapInArrow(_scan(ids, q, k, block, cells), out)
    if probes is None:
        n = max(1, -(-base.count() // part))
        v = base.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long"))
        q = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    else:
        sizes = F.broadcast(base.groupBy("cell").agg(F.ceil(F.count("*") / part).alias("n")))  # one row per cell
        v = base.join(sizes, "cell").withColumn("part", F.col("cell") * 1_000_000 + F.pmod(F.xxhash64("vec_id"), F.col("n")))
        visits = asked.mapInArrow(_visits(probes), f"query_id {qk}, embedding array<float>, cell int")
        q = visits.join(sizes, "cell").withColumn("part", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.col("cell") * 1_000_000 + i)))
    none = lambda kind: F.lit(None).cast(kind)
    rows = v.select("part", F.lit(0).alias("side"), "vec_id", none(qk).alias("query_id"), "embedding").unionByName(
        q.select("part", F.lit(1).alias("side"), none(vk).alias("vec_id"), "query_id", "embedding"))
    return rows.repartition("part").sortWithinPartitions("part", "side").mapInArrow(_meet(k, block), out)


def _visits(probes):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                cells = probes(matrix(b.column("embedding")))
                at = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("embedding").take(at), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "embedding", "cell"])

    return run


def dense_search(queries: DataFrame, stored: DataFrame, k: int, block: int = BLOCK, few: int = FEW_QUERIES, part: int = PART_VECTORS) -> DataFrame:
    """Best ``k`` stored vectors of every query by cosine: query_id, vec_id, score, rank.

    ``queries``: query_id, embedding; ``stored``: vec_id, embedding. The vectors are read
    once for any number of queries, and each part of them returns only its own best.
    Null vectors take no part.
    """
    asked = queries.where("query_id is not null and embedding is not null").select("query_id", F.col("embedding").cast("array<float>"))
    base = stored.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<float>"))
    return top_k(_pairs(asked, base, k, block, None, few, part), "score", k, tie="vec_id")


# ---- clustered index --------------------------------------------------------

def _assign(centroids: np.ndarray):
    """The nearest centroid of each vector."""
    c = unit(centroids)

    def run(batches):
        for b in batches:
            if b.num_rows:
                near = (unit(matrix(b.column(1))) @ c.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near)], names=["vec_id", "embedding", "cell"])

    return run


def sampled(rows: DataFrame, sample: int = 20_000) -> DataFrame:
    """About ``sample`` rows, those whose vec_id hashes lowest."""
    n = rows.count()
    part = 1 << 40
    return rows if n <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(part)) < F.lit(int(part * sample / n)))


def train_centroids(stored: DataFrame, nlist: int, sample: int = 20_000, rounds: int = 15) -> np.ndarray:
    """Spherical k-means on about ``sample`` vectors, those whose ids hash lowest."""
    return k_means(sampled(stored, sample), nlist, rounds)


def k_means(some: DataFrame, nlist: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means on all vectors of a small table."""
    rows = some.select("vec_id", "embedding").orderBy("vec_id").collect()
    if not rows:
        return np.empty((0, 0))
    x = unit(np.array([r.embedding for r in rows], dtype=np.float64))
    c = x[np.linspace(0, len(x) - 1, min(nlist, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.array([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


def cluster(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every stored vector with the cell of its nearest centroid: vec_id, embedding, cell."""
    usable = stored.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    kind = usable.schema["vec_id"].dataType.simpleString()
    return usable.mapInArrow(_assign(centroids), f"vec_id {kind}, embedding array<float>, cell int")


def write_cells(stored: DataFrame, centroids: np.ndarray, path: str) -> None:
    """The clustered index on disk, one folder per cell: a search reads only the folders of the cells it visits."""
    cluster(stored, centroids).write.partitionBy("cell").parquet(path)


def ivf_search(queries: DataFrame, stored: DataFrame, k: int, nlist: int, nprobe: int, centroids: np.ndarray | None = None, block: int = BLOCK,
               few: int = FEW_QUERIES, part: int = PART_VECTORS) -> DataFrame:
    """Best ``k`` of the cells nearest to each query: query_id, vec_id, score, rank.

    Every stored vector is indexed in the cell of its nearest centroid, and a query
    visits ``nprobe`` cells; with nprobe = nlist the result is exact. ``stored`` may hold
    the cells already; those that no query visits are then pruned from the scan.
    """
    usable = stored.where("vec_id is not null and embedding is not null")
    c = centroids if centroids is not None else train_centroids(usable, nlist)
    if not len(c):
        return dense_search(queries, usable, k)
    cells = usable.select("vec_id", F.col("embedding").cast("array<float>"), "cell") if "cell" in stored.columns else cluster(stored, c)
    asked = queries.where("query_id is not null and embedding is not null").select("query_id", F.col("embedding").cast("array<float>"))

    def probes(q: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit(q) @ unit(c).T), axis=1, kind="stable")[:, :nprobe]

    return top_k(_pairs(asked, cells, k, block, probes, few, part), "score", k, tie="vec_id")


def vector_stats(stored: DataFrame) -> DataFrame:
    """Per label: number of vectors, least and largest norm, and dimension."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return stored.withColumn("norm", norm).groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.min("norm"), 6).alias("min_norm"), F.round(F.max("norm"), 6).alias("max_norm"), F.max(F.size("embedding")).cast("long").alias("dim"))
