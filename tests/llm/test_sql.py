"""The training-data queries that SQL can express give the rows that their SQL gives."""

import duckdb
import pytest

registry = pytest.importorskip("helixspark.llm.registry")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df, got = registry.QUERIES[name](spark, sf), c.sql(registry.SQL[name])
    columns = sorted(df.columns)
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {x: kinds[t] for x, t in df.dtypes} == dict(zip(got.columns, map(str, got.types), strict=True))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted((tuple(r[got.columns.index(x)] for x in columns) for r in got.fetchall()), key=key)
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=key) == want
