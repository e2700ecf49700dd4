"""Every registered query of the library proper gives the rows that its SQL gives."""

import duckdb
import pytest

from helixspark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert sorted(got.columns) == columns
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in df.dtypes} == dict(zip(got.columns, map(str, got.types), strict=True))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted((tuple(r[got.columns.index(c)] for c in columns) for r in got.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
