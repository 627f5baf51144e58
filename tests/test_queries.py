"""Every query equals its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from ledgerlake import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events documents conversations benchmark labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows) -> list[str]:
    tidy = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted(repr(tuple(map(tidy, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, duck, name):
    got = engine.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    result = duck.sql(engine.SQL[name])
    assert names == sorted(result.columns)
    at = [result.columns.index(n) for n in names]
    assert plain(tuple(r) for r in got.select(names).collect()) == plain(tuple(r[i] for i in at) for r in result.fetchall())


def test_every_query_has_sql():
    assert set(engine.QUERIES) == set(engine.SQL)
