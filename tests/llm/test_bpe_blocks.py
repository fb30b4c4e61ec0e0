"""Pieces of many blocks and buckets, very long texts and pieces, and columns whose names clash."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from loomline.llm import bpe


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(bpe.VOCABULARY).ranks, special_tokens={})


def want(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"KEPT": 20, "REPLAYED": 30}, {"PIECES": 1, "ROWS": 1, "MOST_BUCKETS": 2}, {"KEPT": 300, "MOST_BUCKETS": 1}])
def test_blocks_and_buckets_change_nothing(spark, library, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bpe, name, value)
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeé中🙂 '1.\n") for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    rows = [(i if i % 9 else None, rnd.choice([None, "", "  ", " ".join(rnd.choices(words, k=rnd.randrange(1, 60)))])) for i in range(150)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, bpe.digests(df).collect()), key=str) == want(library, rows + rows[:5])
    assert bpe.encode(df).filter("not round_trip").count() == 0


def test_long_texts_and_pieces(spark, library):
    rnd = random.Random(9)
    long = " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(1, 12))) for _ in range(250_000))
    rows = [(1, long), (2, "".join(rnd.choices("ab", k=20_000))), (3, "=" * 50_000 + long[:1000]), (4, "x")]
    assert sorted(map(tuple, bpe.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want(library, rows)


def test_merges_out_of_rank_order_take_little_time():
    c = bpe.codec(bpe.VOCABULARY)
    rnd = random.Random(10)
    piece = "".join(rnd.choices("aeinrst", k=100_000)).encode()
    ids = c.one(piece)
    assert c.decode(ids) == piece
    small = piece[:300]
    ranks, plain = c.ranks, [bytes([b]) for b in small]
    while True:
        found = [(ranks[plain[i] + plain[i + 1]], i) for i in range(len(plain) - 1) if plain[i] + plain[i + 1] in ranks]
        if not found:
            break
        i = min(found)[1]
        plain[i : i + 2] = [plain[i] + plain[i + 1]]
    assert c.one(small) == [ranks[p] for p in plain]


def test_clashing_columns(spark, library):
    df = spark.createDataFrame([(1, "some text", 5, "n"), (2, None, 5, "n")], "doc_id long, text string, block int, `a.b` string").toDF("doc_id", "text", "Text", "a.b")
    assert sorted(map(tuple, bpe.digests(df).collect()), key=str) == want(library, [(1, "some text"), (2, None)])
