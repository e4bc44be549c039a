import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexlode.llm.percentiles import ERROR, merge, percentiles, sketch

AT = [0.0, 0.05, 0.5, 0.95, 1.0]


def test_error_bound_and_merging(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 7, "a" if i % 3 else None, float(v)) for i, v in enumerate(np.concatenate([rng.lognormal(3, 4, 900), -rng.lognormal(1, 3, 300), np.zeros(50), [1e300, -1e-300, 5.0, 5.0]]))]
    rows += [(1, "a", None), (1, "a", math.nan), (1, "a", math.inf), (1, "a", -math.inf)]
    df = spark.createDataFrame(rows, "day int, g string, v double").selectExpr("*", "1 as sign", "2 as metric")
    parts = sketch(df, ["day", "g"], ["v"])
    got = {(r.g, r.quantile): (r.estimate, r.n) for r in percentiles(merge(parts, ["g"]), ["g"], AT).collect()}
    for g in ("a", None):
        xs = sorted(v for _, k, v in rows if k == g and v is not None and math.isfinite(v))
        for q in AT:
            true = xs[math.floor(q * (len(xs) - 1))]
            est, n = got[(g, q)]
            assert n == len(xs) and abs(est - true) <= (ERROR + 1e-9) * abs(true)
    whole = percentiles(sketch(df, ["g"], ["v"]), ["g"], AT)
    assert {(r.g, r.quantile, r.estimate) for r in whole.collect()} == {(g, q, e) for (g, q), (e, _) in got.items()}


def test_empty(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert percentiles(sketch(df, ["g"], ["v"]), ["g"], AT).count() == 0
    assert sketch(df.limit(0), ["g"], ["v"]).agg(F.sum("n")).first()[0] is None
    one = percentiles(sketch(spark.createDataFrame([("a", -1.0)], "g string, v double"), ["g"], ["v"]), ["g"], [0.5]).first()
    assert one.estimate == pytest.approx(-1, rel=ERROR * 1.001)
