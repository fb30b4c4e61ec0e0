"""The pipeline over rows without a doc_id, repeated rows, long and null texts, and columns whose names clash."""

import random

import pytest

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "__spans", "score", "a.b", "Text", "row"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    item, long = text(30), text(100_000)
    rows = [(i, text(60), "en", "s", 1) for i in range(120)]
    rows += [(500, rows[0][1], "en", "s", 1), (0, *rows[0][1:]), (0, *rows[0][1:])]  # a copy, and repeated rows
    rows += [(600, long, None, None, None), (601, long + " end", None, None, None)]
    rows += [(None, rows[1][1], None, None, None), (None, text(50), None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(700, "", None, None, None), (701, None, None, None, None), (702, f"{text(20)} {item} x", "en", "s", 1),
        (703, f"{text(30)} password=abcdef12345", "en", "s", 1)]
    labels = [(i, 1, int(i % 12 == 0)) for i in range(120)]
    rows = [(i, t + " blorg blorg" if t and i is not None and i < 120 and i % 12 == 0 and i else t, *x) for i, t, *x in rows]
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_every_stage_keeps_clashing_columns_and_defines_its_edges(spark, folder):
    path, rows = folder
    docs = spark.createDataFrame([(*r, 1, 2, "n", "T", 3) for r in rows],
        ", ".join(f"`c{i}` {t}" for i, t in enumerate("long string string string long int int string string int".split()))).toDF(*COLUMNS)
    stage = dict(cp.STAGES)
    tail = lambda out: {tuple(r)[5:] for r in out.collect()}

    kept = stage["toxicity"](spark, docs, path)
    assert kept.columns == COLUMNS and tail(kept) == {(1, 2, "n", "T", 3)}
    ids = [r[0] for r in kept.collect()]
    assert ids.count(0) == 3 and ids.count(None) == 4 and {700, 701} <= set(ids)

    kept = stage["near_duplicates"](spark, docs, path)
    assert kept.columns == COLUMNS and tail(kept) == {(1, 2, "n", "T", 3)}
    out = [(r[0], r[1]) for r in kept.collect()]
    ids = [i for i, _ in out]
    assert ids.count(0) == 1 and 500 not in ids and 600 in ids and 601 not in ids
    assert sorted(t is None for i, t in out if i is None) == [False, True] and rows[1][1] not in [t for i, t in out if i is None]
    assert {700, 701} <= set(ids)

    kept = stage["decontamination"](spark, docs, path)
    assert kept.columns == COLUMNS and kept.count() == len(rows) - 1 and 702 not in [r[0] for r in kept.collect()]

    masked = stage["secrets"](spark, docs, path)
    assert masked.columns == COLUMNS and masked.count() == len(rows) and tail(masked) == {(1, 2, "n", "T", 3)}
    out = {r[0]: r for r in masked.collect()}
    assert out[703][1].endswith(" [SECRET]") and out[703][4] == len(out[703][1]) and out[701][1] == "" and out[701][4] == 0

    coded = stage["tokens"](spark, docs, path).collect()
    assert len(coded) == len(rows) and all(r.round_trip for r in coded) and sum(r.n_tokens == 0 for r in coded) == 4

    none = docs.limit(0)
    for _, s in cp.STAGES:
        none = s(spark, none, path)
    assert none.count() == 0


def test_run_over_rows_without_ids(spark, folder):
    path, rows = folder
    out = cp.run(spark, path).collect()
    ids = [r.doc_id for r in out]
    assert ids.count(0) == 1 and not {500, 601, 702} & set(ids) and {600, 700, 701, 703} <= set(ids) and ids.count(None) == 2
    assert all(r.round_trip for r in out)
