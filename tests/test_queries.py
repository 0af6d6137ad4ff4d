"""Registered queries against their oracle SQL in DuckDB, and the shape of the registry."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {k: f for m in entry._modules() for k, f in m.QUERIES.items()}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(OWN) > 180
