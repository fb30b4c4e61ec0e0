import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from loomline.llm import bpe


@pytest.fixture(scope="module")
def library():
    ranks = bpe.codec(bpe.VOCABULARY).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(3)
    out = ["", " ", "a" * 700, "<|endoftext|>", "it's We'LL\r\n\r\n  x", "\x1c\x1d\x85\xa0  z", "".join(map(chr, range(0x20, 0x3000)))]
    return out + ["".join(rnd.choice("ab cA1 .\n'sé中🙂") for _ in range(200)) for _ in range(100)]


def test_ids_equal_the_library(library, monkeypatch):
    c = bpe.codec(bpe.VOCABULARY)
    assert [c.encode(t) for t in texts()] == [library.encode_ordinary(t) for t in texts()]
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    monkeypatch.setattr(bpe, "KEPT", 20)
    assert [c.encode(t) for t in texts()] == [library.encode_ordinary(t) for t in texts()]


def test_single_pieces_agree_with_replay():
    c = bpe.codec(bpe.VOCABULARY)
    words = [w.encode() for w in ("internationalisation", "aaaaaaaa", "中文字", "ééé")]
    assert [list(x) for x in c.replay(words)] == [[c.ranks[w]] if w in c.ranks else c.one(w) for w in words]


def test_digests_and_round_trip(docs, empty, library):
    rows = bpe.digests(docs).collect()
    assert len(rows) == docs.count()
    want = {}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in rows} == want
    coded = bpe.encode(docs)
    assert coded.filter("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in bpe.decode(coded).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
    assert bpe.digests(empty).count() == bpe.encode(empty).count() == 0
