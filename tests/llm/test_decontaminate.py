import random

import numpy as np

from loomline.llm import decontaminate as dc


def distance(p, t):
    """Least edits of p against any substring of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k = rnd.randrange(len(s))
        how = rnd.randrange(3)
        if how == 0:
            s[k] = rnd.choice("xyz")
        elif how == 1:
            del s[k]
        else:
            s.insert(k, rnd.choice("xyz"))
    return "".join(s)


def test_hits_match_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.randrange(4, 30))) for i in range(12)]
    docs, want = [], {}
    for d in range(120):
        i, t = rnd.choice(items)
        docs.append((d, text(20) + " " + edited(rnd, t, rnd.randrange(0, 2 + len(t) // 8)) + " " + text(20)))
        want[d] = [j for j, p in items if distance(p, docs[-1][1]) <= dc.budget(len(p))]
    out = dc.leak_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in out} == want
    assert 20 < sum(map(bool, want.values())) < 118
    for r in out:
        for h in r.hits:
            t = dict(docs)[r.doc_id][h.start : h.end]
            assert distance(dict(items)[h.item_id], t) == h.edits


def test_align_finds_the_place():
    p, t = (np.array(list(map(ord, s)), np.uint32) for s in ("benchmark", "xxbenchmarkyy"))
    assert dc.align(p, t, 0) == (2, 11, 0)
    t = np.array(list(map(ord, "xxbenxchmarkyy")), np.uint32)
    assert dc.align(p, t, 1) == (2, 12, 1) and dc.align(p, t, 0) is None


def test_passes_of_items_add_up(spark, monkeypatch):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "epsilon zeta eta theta"), (3, "short"), (4, None),
        (None, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x ALPHA beta\ngamma delta epsilon zeta eta theta", 3), (2, "clean", 4), (3, None, None)], "doc_id long, text string, hits long")
    whole = dc.leak_report(docs, items).collect()
    monkeypatch.setattr(dc, "PASS_CHARS", 5)
    assert dc.leak_report(docs, items).collect() == whole
    assert [r.item_ids for r in whole] == [[1, 2], [], []]
    assert [tuple(r) for r in dc.clean(docs, items).collect()] == [(2, "clean", 4), (3, None, None)] and dc.clean(docs, items).columns == docs.columns


def test_edges(docs, empty, spark):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    out = {r.doc_id: r.contaminated for r in dc.leak_report(docs, items).collect()}
    assert [out[i] for i in range(12)] == [False] * 5 + [True] * 4 + [False] * 3
    assert dc.leak_report(docs, items).count() == docs.count() and dc.leak_report(empty, items).count() == 0
    assert dc.leak_report(docs, items.filter("false")).filter("contaminated").count() == 0
