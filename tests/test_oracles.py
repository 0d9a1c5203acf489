"""Every query against its SQL in another engine; those without SQL must give rows and the same schema twice."""

import datetime
import decimal
import math

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        raise AssertionError(f"decimal {v}: cast it")
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, engine, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    cursor = engine.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, cursor.fetchall())
    assert got == want and got
