"""Shards against the sorted order worked out by hand, the files, and edges of the input."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from loomline.llm import shards


def order_of(rows):
    """(key, doc_id, size) of all rows, in the order in which shards cut them."""
    key = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)
    return sorted((key(t or ""), -(1 << 63) if i is None else i, len((t or "").encode()) + 1) for i, t in rows)


@pytest.mark.parametrize("kind", ["short", "hot", "few", "long", "twins"])
def test_shards_are_ranges_cut_where_they_should_be(spark, kind, n=8):
    rnd = random.Random(kind)
    texts = {
        "short": lambda i: "é" * rnd.randrange(300), "hot": lambda i: "hot " * 30 if i % 3 else f"t{i}" * rnd.randrange(20), "few": lambda i: f"{i % 5}" * 50,
        "long": lambda i: f"{i}" * (20_000 if i == 7 else 3), "twins": lambda i: f"text {i // 6} " * 3}[kind]
    rows = [(i if i % 50 else None, texts(i)) for i in range(2500)]
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), n).collect()
    total = sum(r.size for r in out)
    near, group_near = total / n * shards.TOLERANCE, total / n * shards.GROUP_TOLERANCE
    held = Counter((k, i) for k, i, _ in order_of(rows))
    shard_of = {}
    for r, (key, doc_id, _) in ((r, order_of([(r.doc_id, r.text)])[0]) for r in out):
        assert shard_of.setdefault((key, doc_id), r.shard) == r.shard
    ordered = [shard_of[k, i] for k, i, _ in order_of(rows)]
    assert ordered == sorted(ordered) and len(shard_of) == len(held)
    # Every boundary of single rows and of groups, as bytes up to it.
    upto, singles, groups = 0, [0], [0]
    sorted_rows = order_of(rows)
    for at, (k, i, size) in enumerate(sorted_rows):
        upto += size
        last = at + 1 == len(sorted_rows)
        if last or sorted_rows[at + 1][:2] != (k, i):
            singles.append(upto)
        if last or sorted_rows[at + 1][0] != k:
            groups.append(upto)
    for s in range(1, n):
        cut = sum(r.size for r in out if r.shard < s)
        target = total * s / n
        whole, single = (min(abs(x - target) for x in at) for at in (groups, singles))
        assert abs(cut - target) <= max(near, single) or (cut in groups and abs(cut - target) <= max(group_near, whole))
        if whole <= group_near:
            assert cut in groups


def test_slots_are_gapless_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(shards, "SLOT_ROWS", 10)
    out = shards.assign(spark.createDataFrame([(i, f"text {i % 300}") for i in range(1000)], "doc_id long, text string"), 4).collect()
    for s in range(4):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))


def test_clashing_columns_stay(spark):
    names = ["_text", "_start", "_key", "_id", "_own", "_group", "key", "id", "a.b", "within", "c0"]
    row = (1, "x", *range(len(names)))
    df = spark.createDataFrame([row, row, (None, None, *range(len(names)))], ["doc_id", "text", *names])
    out = shards.assign(df.withColumn("Shard", F.lit("s")), 2)
    assert out.columns == ["doc_id", "text", *names, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert all(tuple(r)[2 : 2 + len(names)] == tuple(range(len(names))) for r in out.collect())


def test_write_exchanges_texts_once(spark, tmp_path, empty):
    df = spark.createDataFrame([(i, f"text {i}" * (i % 7), i) for i in range(500)], "doc_id long, text string, more long")
    shards.write(df, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == {(r.doc_id, r.shard, r.slot) for r in shards.assign(df, 3).collect()}
    for path in back.inputFiles():
        slots = [r.slot for r in spark.read.parquet(path).collect()]
        assert slots == sorted(slots)
    plan = shards.assign(df, 3).sortWithinPartitions("shard", "slot")._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in x and "c1" not in x for x in plan.splitlines()) <= 2
    shards.write(empty, str(tmp_path / "none"), 3)


def test_two_rows_take_few_scans(spark, monkeypatch):
    scans = []
    gaps = shards._gaps
    monkeypatch.setattr(shards, "_gaps", lambda *a: scans.append(1) or gaps(*a))
    out = shards.assign(spark.createDataFrame([(1, "a"), (2, "bcd")], "doc_id long, text string"), 2).collect()
    assert {r.shard for r in out} == {0, 1} and len(scans) <= 4
