import random
import re
from collections import defaultdict

import numpy as np

from loomline.llm import minhash
from loomline.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    near = defaultdict(set)
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 100 * len(x & y) >= 75 * len(x | y) and x and y:
                near[a].add(b)
                near[b].add(a)
    out = {}
    for d in sorted(sets):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = d
                todo += near[x]
    return {d: (len(sets[d]), out[d], out[d] == d) for d in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def variants(seed=7):
    """Groups of copies at every distance, chains among them, and a passage that many unrelated texts share."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out, passage = [], " ".join(rnd.choices(vocabulary, k=60))
    for group in range(12):
        words = rnd.choices(vocabulary, k=rnd.choice([12, 60, 120, 300]))
        for _ in range(rnd.choice([1, 3, 30])):
            copy = list(words)
            for _ in range(rnd.randrange(0, max(2, len(words) // 20))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            out.append(" ".join(copy))
            if group % 3 == 0:
                words = copy
    out += [passage + " " + " ".join(rnd.choices(vocabulary, k=rnd.randrange(10, 60))) for _ in range(60)]
    rnd.shuffle(out)
    return list(enumerate(out))


def test_components_match_brute_force(spark):
    rows = variants()
    got = result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_blocks_of_strays_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = variants(11)
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    assert [got[i].n_shingles for i in range(5)] == [0, 0, 0, 1, 1]
    assert all(got[i].component_id == i and got[i].kept for i in range(5))
    assert [got[i].component_id for i in (5, 6, 7, 8, None)] == [5, 5, 5, 5, 5]
    assert not got[None].kept
    assert minhash.near_duplicates(empty).count() == 0


def test_signature_is_circulant():
    x = np.array([3, 77, 123456789], np.uint64)
    whole = minhash.signatures(x, np.array([0, 3]), 8)
    alone = np.stack([minhash.signatures(x[i : i + 1], np.array([0, 1]), 8) for i in range(3)])
    assert (whole[:, 0] == alone[:, :, 0].min(axis=0)).all()


def test_word_hashes_keep_texts_apart():
    raw, at = tx.bytes_of(__import__("pyarrow").array(["ab", "ab c", None, "Ab"]))
    h, first = tx.word_hashes(raw, at)
    assert first.tolist() == [0, 1, 3, 3, 4] and h[0] == h[1] == h[3] != h[2]
