"""A bounded, repeatable sample of a table for fitting a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 40


def hashed_sample(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """About ``size`` rows (all, if there are fewer): those whose ids hash below size / rows.

    One count and one filtered scan; nothing is sorted or shuffled, so the cost
    beyond the scan does not grow with the table.
    """
    n = df.count()
    if n <= size:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(_PARTS)) < F.lit(int(_PARTS * size / n)))
