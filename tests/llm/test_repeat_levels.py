"""Levels in the query itself, anchors that very many runs share, order of the arrays, edges of the input."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_repeats import brute, corpus, result

from loomline.llm import queries, repeats


def test_the_query_merges_levels(spark, tmp_path, monkeypatch):
    made = []
    own = repeats.Index.add

    def add(self, docs):
        own(self, docs)
        made.append(([n for n, _ in self.levels], self.merges))

    monkeypatch.setattr(repeats.Index, "add", add)
    docs = corpus(31)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert result(queries.op7_suffix_repeats(spark, str(tmp_path))) == brute(docs, 100)
    assert made == [([1], 0), ([2], 1), ([2, 1], 1), ([4], 3), ([4, 1], 3), ([4, 2], 4), ([4, 2, 1], 4), ([8], 7)]


@pytest.mark.parametrize("limits", [{"HOT": 2}, {"MOST": 20, "CHUNK": 5, "HOT": 3}, {"HOT": 2, "MOST": 10, "CHUNK": 1, "FEW": 1}, {"BUCKET_BYTES": 1, "MOST_BUCKETS": 3}])
def test_anchors_of_very_many_runs(spark, monkeypatch, limits):
    """A passage too short to be a repeat by itself stands in most texts, so that its anchors have as many runs."""
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, long = text(90), text(150)
    docs = [(d, text(rnd.randrange(80)) + passage + text(rnd.randrange(120)) + (long[rnd.randrange(60) :] if d % 3 == 0 else "")) for d in range(90)]
    docs += [(200 + d, docs[d][1]) for d in range(0, 60, 7)]
    assert result(repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))) == brute(docs, 100)


def test_levels_are_in_order_of_their_suffixes(spark):
    index = repeats.Index(buckets=4)
    docs = corpus(7)
    for k in range(2):
        index.add(spark.createDataFrame([d for d in docs if d[0] % 2 == k], "id long, text string"))
    (size, level), = index.levels
    raw = {d: (t or "").encode() for d, t in docs}
    n = 0
    for row in level.collect():
        key, own, place = repeats._unpacked(row.n, row["size"], row.data, repeats.GRAM + 8, 0, 0)
        grams = [bytes(k[: repeats.GRAM]) for k in key]
        assert grams == sorted(grams) and len({bytes(k) for k in key}) == row.n
        first, last = repeats._range(place)
        assert all(g in raw[d][f : z + repeats.LENGTH] for g, d, f, z in zip(grams, own.tolist(), first.tolist(), last.tolist(), strict=True))
        n += row.n
    assert size == 2 and index.merges == 1 and n > 100


def test_arrays_pack_and_unpack():
    rnd = np.random.default_rng(1)
    rows, ids = rnd.integers(0, 256, (50, 32), np.uint8), rnd.integers(-(2**62), 2**62, 50)
    n, size, data = repeats._packed(rows, ids)
    back = repeats._unpacked(n, size, data, 32, 0)
    assert (back[0] == rows).all() and (back[1] == ids).all()


def test_equal_hashes_of_different_bytes_are_no_repeat():
    raw, at = tx_bytes(["x" * 120, "y" * 120])
    hashed, zero = np.zeros(2, np.uint64), np.zeros(2, np.uint64)
    ids, start = np.array([1, 2]), np.zeros(2, np.int64)
    assert repeats._firsts((hashed, zero), ids, start).tolist() == [True, False]
    assert repeats._firsts((hashed, zero), ids, start, lambda a, b: raw[at[a]] == raw[at[b]]).tolist() == [True, True]


def tx_bytes(texts):
    from loomline.llm import text as tx

    return tx.bytes_of(pa.array(texts))


def test_long_texts_and_clashing_columns(spark):
    rnd = random.Random(3)
    body = "".join(rnd.choices("abcdefghij ", k=1_500_000))
    rows = [(1, body + body[:5000], 1, "n"), (2, "z" + body[1000:300_000], 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, `a.b` string").toDF("doc_id", "text", "Text", "a.b")
    out = {r.doc_id: r for r in repeats.remove_repeats(df).collect()}
    assert (out[1].n_removed, out[1].n_spans) == (5000, 1) and (out[2].n_removed, out[2].n_spans) == (299_000, 1)


@pytest.mark.parametrize("limits", [{}, {"MOST": 4, "CHUNK": 2, "HOT": 2}, {"MOST": 30, "CHUNK": 7, "HOT": 5}, {"MOST": 1, "CHUNK": 1, "HOT": 2}])
def test_buckets_that_grow_too_large_lose_nothing(monkeypatch, limits):
    """The merge-scan in this process, batch by batch, with its marked runs compared string by string."""
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    passage = text(95)
    docs = corpus(17) + [(100 + d, text(rnd.randrange(60)) + passage + text(rnd.randrange(60))) for d in range(60)]
    docs += [(300 + d, docs[-d - 1][1]) for d in range(10)]
    levels, repeated, marked, witnesses = [], [], [], 0
    batches = [docs[k : k + 40] for k in range(0, len(docs), 40)]
    for k, part in enumerate(batches):
        source = [pa.RecordBatch.from_pydict({"id": [d for d, _ in part], "text": [t for _, t in part]})]
        rows = [r for b in repeats._entries(100, repeats.GRAM, 2)(iter(source)) for r in b.to_pylist()]
        rows += [r | {"source": repeats._STAYING if k % 2 else repeats._FRESH} for level in levels for r in level]
        rows.sort(key=lambda r: (r["bucket"], -r["source"]))
        batch = repeats._batch([tuple(r[n] for n in ("bucket", "source", "n", "size", "data")) for r in rows], repeats._ROWS)
        out = [r for b in repeats._merge_scan(repeats.GRAM)(iter([batch])) for r in b.to_pylist()]
        new = [{x: r[x] for x in ("bucket", "n", "size", "data")} for r in out if r["kind"] == "level"]
        levels = [*levels, new] if k % 2 else [new]
        for kind, found in (("repeat", repeated), ("marked", marked)):
            for r in (r for r in out if r["kind"] == kind):
                own, place, *_ = repeats._unpacked(r["n"], r["size"], r["data"], *[0] * (r["size"] // (8 * r["n"])))
                found += zip(own.tolist(), *(x.tolist() for x in repeats._range(place)), strict=True)
    raw = {d: t.encode() for d, t in docs}
    gone = {(d, s) for d, f, z in repeated for s in range(f, z + 1)}
    seen = set()
    for d, s in sorted({(d, s) for d, f, z in marked for s in range(f, z + 1)}):
        w = raw[d][s : s + 100]
        if w in seen:
            gone.add((d, s))
        seen.add(w)
    first, want = set(), set()
    for d, t in sorted(raw.items()):
        for s in range(len(t) - 99):
            if t[s : s + 100] in first:
                want.add((d, s))
            first.add(t[s : s + 100])
    assert gone == want and len(want) > 500
