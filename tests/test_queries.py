"""Every query with SQL against DuckDB, as the driver compares them."""

import duckdb
import pytest

from lodestore.queries import ORACLES, QUERIES

from .conftest import DATA

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(spark, query, sql):
    got = query(spark, DATA)
    want = duck().sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    left = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    right = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
    assert left == right
    return len(left)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name])
