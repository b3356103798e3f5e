"""Queries with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from adlift.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "embeddings", "pages"):
        path = f"{SF}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cursor = db.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple(str(v) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted(cursor.fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)
