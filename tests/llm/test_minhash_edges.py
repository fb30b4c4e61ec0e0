"""Sizes of blocks, regular strings, long texts, repeated rows and columns whose names clash."""

import random

import numpy as np
import pytest
from test_minhash import brute, result

from loomline.llm import minhash


@pytest.mark.parametrize("block", [3, 256])
def test_strays_of_all_sizes_match_brute_force(spark, monkeypatch, block):
    """Sets that grow step by step around shared passages: links at the edge of the threshold, over many sizes."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(6):
        base = rnd.choices(words, k=400)
        n = 12
        while n < 400:
            texts.append(" ".join(base[:n]))
            n = int(n * rnd.choice([1.1, 1.3, 1.34, 1.5])) + 1
    passage = rnd.choices(words, k=100)
    texts += [" ".join(passage + rnd.choices(words, k=rnd.randrange(5, 200))) for _ in range(60)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("threshold", [50, 90, 100])
def test_other_thresholds(spark, threshold):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (12, 20, 24, 40, 44, 45, 80, 81, 160)] * 2
    rows = list(enumerate(texts))
    sets = [max(len(t.split()) - 4, 1) for t in texts]
    got = result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold, bands=128, rows=1))
    reach = {}
    for i in sorted(range(len(sets)), key=lambda i: sets[i]):  # each set holds all smaller ones
        near = [reach[j] for j in reach if 100 * min(sets[i], sets[j]) >= threshold * max(sets[i], sets[j])]
        low = min([i, *near])
        reach = {j: low if r in near else r for j, r in reach.items()} | {i: low}
    assert {d: c for d, (_, c, _) in got.items()} == reach


def test_regular_strings_are_not_taken_for_each_other(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate({97: "b", 98: "a"})
    b = a.translate({97: "b", 98: "a"})
    rows = [(1, " ".join([a] * 3 + ["x"] * 3)), (2, " ".join([b] * 3 + ["x"] * 3))]
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    rnd = random.Random(1)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(200_000))
    rows = [(1, text, 5, 6, "n"), (2, text + " more", 5, 6, "n"), (2, text + " more", 5, 6, "n"), (3, "alone in the world of texts", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int, bands int, `a.b` string").toDF("doc_id", "text", "rep", "Text", "a.b")
    out = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert out == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]


def test_a_block_joins_components_with_few_links():
    rnd = random.Random(6)
    sets = []
    for _ in range(8):
        base = {rnd.randrange(10**6) for _ in range(100)}
        sets += [base - set(rnd.sample(sorted(base), k=rnd.randrange(18))) for _ in range(20)]
    rows = [(i, i if rnd.random() < 0.5 else 1000 + i // 20, np.array(sorted(x), np.uint64)) for i, x in enumerate(sets)]
    for size in (1, 60, len(rows)):
        asks, met = rows[:size], rows[size // 2 :]
        links = list(minhash._links(asks, met, 75))
        component = {c: c for _, c, _ in rows}
        comp_of = {i: c for i, c, _ in rows}

        def closed(pairs, parent):
            for a, b in pairs:
                x, y = parent[comp_of[a]], parent[comp_of[b]]
                for c in parent:
                    parent[c] = min(x, y) if parent[c] in (x, y) else parent[c]
            return parent

        every = [(i, j) for i, _, x in asks for j, _, y in met if i != j and 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))]
        assert closed(links, dict(component)) == closed(every, dict(component))
        assert len(links) < len(component) and set(links) <= set(every)
