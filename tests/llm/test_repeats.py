import hashlib
import random

import pytest

from loomline.llm import repeats


def brute(docs, length):
    """docs in order of id -> (n_bytes, n_removed, n_spans, digest)."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        raw = (text or "").encode()
        gone = [False] * (len(raw) + 1)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    common = [text(rnd.randrange(50, 300)) for _ in range(6)]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rnd.randrange(0, 5)):
            kind = rnd.randrange(5)
            if kind == 0:
                parts.append(rnd.choice(common))
            elif kind == 1:
                c = rnd.choice(common)
                a = rnd.randrange(len(c))
                parts.append(c[a : a + rnd.randrange(1, 200)])
            elif kind == 2:
                parts.append("ab" * rnd.randrange(200))
            elif kind == 3 and docs:
                parts.append(rnd.choice(docs)[1])
            else:
                parts.append(text(rnd.randrange(200)))
        docs.append((d, "".join(parts)))
    return docs


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_equals_brute_force(spark, batches):
    docs = corpus(batches)
    got = result(repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), batches=batches))
    assert got == brute(docs, 100)


def test_short_strings_and_small_blocks(spark, monkeypatch):
    docs = corpus(9)
    assert result(repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=20, gram=6)) == brute(docs, 20)
    monkeypatch.setattr(repeats, "FEW", 2)
    assert result(repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs, 100)
    monkeypatch.setattr(repeats, "BLOCK", 150)
    ids, offset, raw, at = next(iter(repeats._pieces(iter([__import__("pyarrow").RecordBatch.from_pydict({"id": [7], "text": ["x" * 1000]})]), 100)))
    assert len(raw) == 249 and ids.tolist() == [7]


def test_levels_merge_like_a_counter(spark):
    index = repeats.Index()
    sizes = []
    for k in range(6):
        index.add(spark.createDataFrame([(k, f"{k} " * 200)], "id long, text string"))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2]]


def test_edges(spark, docs, empty):
    rows = repeats.remove_repeats(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_bytes == 0 and by[11].n_removed == 6000 - 2 and by[11].n_spans == 1
    assert repeats.remove_repeats(empty).count() == 0
    long = "same text of one hundred bytes and more " * 3
    both = spark.createDataFrame([(1, long), (1, long), (1, long + "!"), (2, long), (None, long)], "doc_id long, text string")
    got = repeats.remove_repeats(both, whole=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 99) for r in got)[0] == (0, False) and sum(r.n_removed == 0 for r in got) == 1 and len(got) == 5
