"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlode.session import cut, discard


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge table with the least node of its component.

    Alternates two steps on the edge table itself until nothing changes: every
    node hands its larger neighbours, then its smaller ones, to the least node it
    knows. The number of rounds grows with the logarithm of the longest path, and
    a node with very many neighbours is met only by aggregates that combine
    before the shuffle. Each round is written to the shared folder.

    Edges with a null end are ignored, self-loops give a component of one node,
    repeated and reversed edges count once, an empty table gives an empty result.
    Returns ``node`` and ``component``.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    every = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = cut(raw.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        down = large.where("v < u")
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        nxt = (
            down.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        )
        last, links = links, cut(nxt, "cc-edges")
        discard(last)
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return every.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
