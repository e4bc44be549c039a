"""Percentiles of large numeric columns from mergeable logarithmic sketches.

A value v > 0 is counted in bucket ceil(log_g v) with g = (1 + a) / (1 - a); the
bucket's middle 2 g^i / (g + 1) is within the relative error ``a`` of every value in
it. Negative values have buckets of their own sign, zero has one. A sketch is the
table of bucket counts of a part (a day, a partition); parts combine by adding
equal buckets, so the result does not depend on how the data were parted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01


def _log_base(error: float) -> float:
    return math.log((1 + error) / (1 - error))


def bucket(value: Column, error: float = ERROR) -> Column:
    """Bucket of a finite value as a struct (sign, index)."""
    return F.struct(
        F.signum(value).cast("int").alias("sign"),
        F.when(value == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(value)) / F.lit(_log_base(error)))).cast("int").alias("index"))


def middle(sign: Column, index: Column, error: float = ERROR) -> Column:
    """The value a bucket stands for, within the relative error of each value in it."""
    return sign * F.exp(index * F.lit(_log_base(error))) * F.lit(1 - error)


def sketch(rows: DataFrame, by: list[str], metrics: list[str], error: float = ERROR) -> DataFrame:
    """Bucket counts per group and metric: by..., metric, sign, index, n.

    Null, NaN and infinite values are not counted. Null group keys are groups of
    their own. Counts are added up within each partition before the shuffle, so a
    hot group costs no more than its buckets.
    """
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    long = rows.select(*by, F.explode(values).alias("v")).select(*by, "v.metric", "v.value")
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    return finite.withColumn("b", bucket(F.col("value"), error)).groupBy(*by, "metric", "b.sign", "b.index").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Add equal buckets of the parts; ``by`` names the keys that stay."""
    return sketches.groupBy(*by, "metric", "sign", "index").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, by: list[str], at: list[float], error: float = ERROR) -> DataFrame:
    """One row per group, metric and quantile: n, quantile, estimate.

    The estimate is within the relative ``error`` of the value at rank
    floor(q (n - 1)) of the sorted values. A group's window holds its buckets, whose
    number grows with the logarithm of the range of its values, not with its rows.
    """
    keys = [*by, "metric"]
    order = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("index"))
    run = sketches.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    asked = run.withColumn("quantile", F.explode(F.array(*(F.lit(float(q)) for q in at))))
    rank = F.floor(F.col("quantile") * (F.col("total") - 1))
    hit = asked.where((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    return hit.select(*keys, F.col("total").alias("n"), "quantile", middle(F.col("sign"), F.col("index"), error).alias("estimate"))
