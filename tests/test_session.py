"""Durable tables and the scope that deletes them."""

from pathlib import Path

import pytest

from loomline import session as s


def local(df):
    return Path(df.durable_path.removeprefix("file:"))


def test_a_scope_deletes_what_is_not_kept(spark):
    outer = s.durable(spark.range(3), "outer")
    with s.scope(spark) as kept:
        a, b = s.durable(spark.range(5), "a"), s.durable(spark.range(7), "b")
        kept.append(b)
        assert a.count() == 5
    assert local(outer).exists() and local(b).exists() and not local(a).exists()
    assert b.count() == 7
    with pytest.raises(ValueError, match="x"), s.scope(spark):
        c = s.durable(spark.range(2), "c")
        raise ValueError("x")
    assert not local(c).exists()
    s.discard(outer, b)
    assert not local(outer).exists() and not {outer.durable_path, b.durable_path} & set(s._MADE)


def test_buckets_are_grouped_without_an_exchange(spark):
    df = s.durable_buckets(spark.range(100).selectExpr("id % 7 as k", "id"), "k", "buckets")
    plan = df.groupBy("k").count()
    assert {r.k: r["count"] for r in plan.collect()} == {k: len(range(k, 100, 7)) for k in range(7)}
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("buckets")]
    s.discard(df)
