"""Every query that has SQL, against DuckDB on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("LOOMLINE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    b = sorted((tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert a == b


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_named_once():
    assert set(SQL) <= set(entry.queries())
