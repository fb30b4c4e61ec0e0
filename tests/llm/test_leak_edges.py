"""Short items, long texts, repeated rows and columns whose names clash."""

import random
import re
import time

from loomline.llm import decontaminate as dc


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "cat"), (2, "a b"), (3, "é"), (4, "  "), (5, ""), (6, "12"), (7, "cat"), (8, "sevenxx")]
    texts = ["the Cat sat", "concatenate", "x a\tb y", "ba b", "é", "né", "112 12", "", None, "sevenxx.", "sevenxxx", "cat"]
    out = dc.leak_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for t in texts:
        low = re.sub(r"[\t-\r]", " ", (t or "").lower())
        want.append(sorted(i for i, p in items if p.strip() and re.search(rf"(?<![a-z0-9é]){re.escape(p)}(?![a-z0-9é])", low)))
    assert [r.item_ids for r in out] == want and want[0] == [1, 7] and want[1] == []
    assert all(h.edits == 0 for r in out for h in r.hits)


def test_a_long_text_with_items_throughout(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(2, 8)))
    item = " ".join(word() for _ in range(20))
    text = " ".join(word() for _ in range(200_000))
    text = f"{item} {text} {item} {text[:1000]} {item}"
    began = time.monotonic()
    r = dc.leak_report(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert [h.start for h in r.hits if h.edits == 0] == [m.start() for m in re.finditer(re.escape(item), text)]
    assert len(text) > 900_000 and time.monotonic() - began < 30


def test_clashing_columns_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta", "x")], "item_id long, text string, doc_id string")
    rows = [(1, "alpha beta gamma delta", "v", 2, 3), (2, "clean", "v", 2, 3), (2, "clean", "v", 2, 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, __hits int, more int").toDF("doc_id", "text", "a.b", "__hits", "hits")
    kept = dc.clean(df, items)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    assert dc.find_leaks(df, items).columns == ["doc_id", "text", "a.b", "__hits", "hits"]
    assert dc.clean(df.limit(0), items).count() == 0
    both = df.toDF("doc_id", "text", "Text", "x", "y")
    assert dc.clean(both, items).columns == both.columns and dc.clean(both, items).count() == 3
