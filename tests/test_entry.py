"""Every registered query on the smallest tables, against its SQL twin where it has one."""

import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(tuple(map(_plain, r)) for r in df.select(cols).collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        r = duck.execute(sql)
        names = [c[0] for c in r.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        want = Counter(tuple(_plain(row[i]) for i in order) for row in r.fetchall())
        assert got == want
