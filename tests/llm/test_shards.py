import random
import zlib

from loomline.llm import shards


def check(rows, total, n=8, tolerance=0.01):
    for k in range(n):
        own = [r for r in rows if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        if total:
            assert abs(sum(r.size for r in own) - total / n) <= tolerance * total / n + max(r.size for r in rows)


def test_bytes_are_near_equal_with_a_hot_text(spark):
    rnd = random.Random(2)
    rows = [(i, "hot text " * 20 if i % 3 == 0 else "x" * rnd.randrange(400)) for i in range(3000)]
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows}
    check(out, sum(len(t) + 1 for _, t in rows))
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    assert len({r.shard for r in out if r.text.startswith("hot")}) <= 4


def test_equal_texts_stay_together_where_they_fit(spark):
    rows = [(i, f"text {i // 4}") for i in range(4000)]
    out = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.02).collect()
    by = {}
    for r in out:
        by.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 7


def test_edges(docs, empty):
    out = shards.assign(docs).collect()
    assert len(out) == docs.count() and {r.size for r in out if not r.text} == {1}
    check(out, 0)
    assert shards.assign(empty).count() == 0
    assert [c for c in shards.assign(docs).columns][:7] == docs.columns
