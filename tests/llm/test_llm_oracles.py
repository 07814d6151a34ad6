"""The queries of this subpackage that have SQL, compared with DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import os

import duckdb
import pytest

from mnemospark.llm import queries, sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    statement = sql.oracle_sql().get(name)
    if statement is None:
        return
    duck = duckdb.connect()
    for f in sorted(os.listdir(FOLDER)):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    result = duck.execute(statement)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(x[i]) for i in at) for x in result.fetchall())
