"""Every query with SQL is compared with DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from mnemospark.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else repr(v)
    return v


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ordered(rows) == ordered([tuple(x[i] for i in at) for x in r.fetchall()])


def test_flagship(spark):
    assert registry.flagship(spark, FOLDER).count() > 0
