"""The pipeline's near_duplicates stage where doc_ids are null or repeat."""

import corpus_pipeline as cp

A, B, C, D = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(cp.STAGES)["near_duplicates"](spark, docs, None)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_one_row_of_each_group_stays(spark):
    rows = [(1, A), (1, A), (2, A), (3, B), (3, C), (4, B), (2, C), (None, D), (None, D), (None, A), (5, "x " + D), (6, ""), (6, ""), (7, ""), (None, None), (None, None)]
    assert kept(spark, rows) == sorted([(1, A), (3, B), (2, C), (5, "x " + D), (6, ""), (7, ""), (None, None)], key=str)


def test_null_ids_alone(spark):
    assert kept(spark, [(None, D), (None, D), (None, "x " + D), (None, B)]) in ([(None, B), (None, t)] for t in (D, "x " + D))


def test_unique_ids_are_kept_as_before(spark):
    assert kept(spark, [(3, A), (1, A), (2, B), (4, "")]) == [(1, A), (2, B), (4, "")]
