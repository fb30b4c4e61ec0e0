import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from loomline.llm import quality
from loomline.llm import text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n")]
    seen, dup = set(), 0
    for x in lines:
        dup += bool(WORD.search(x)) and x in seen
        seen.add(x)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measures_match_brute_force():
    rnd = random.Random(1)
    texts = ["", "\n", "a", "a\n", "\na\na", "a\n\n\na\n", "a b c a b c",
        " x\n x\nx"] + ["".join(rnd.choice("ab é\n #<") for _ in range(rnd.randrange(60))) for _ in range(400)]
    got = quality.measure(*tx.bytes_of(pa.array(texts)))
    assert list(zip(*(got[n].tolist() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [brute(t) for t in texts]


def test_hosts_that_fail_lose_all(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "bad", "spam") for i in range(200)] + [(1000 + i, good, f"h{i % 5}") for i in range(200)] + [(2000, good,
        None), (2001, good, "new")]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[0].base_failed and not out[0].kept
    assert all(out[1000 + i].kept for i in range(200)) and out[2000].kept and out[2001].kept
    # a host with one failing document is drawn to the others
    assert 0 < out[2001].host_rate < 0.75


def test_edges(docs, empty):
    out = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert out[0].n_words == 0 and out[0].base_failed and not out[0].kept
    assert out[11].n_repeat_words == 3000 and out[11].base_failed
    assert quality.judge(docs).count() == docs.count()
    assert quality.judge(empty).count() == 0
    assert np.isfinite([r.host_rate for r in out.values() if r.host]).all()


def test_each_rule_rejects_hosts_by_its_own_rate(spark):
    """Documents that pass by themselves go with a host whose other documents break one rule for certain."""
    good = " ".join(f"w{i}" for i in range(60))
    bad = {"symbols": good + " #" * 20, "repeated_lines": good + "\nx y" * 3, "few_words": "few", "repeated_words": "a b c " * 30}
    rows, i = [], 0
    for rule, text in bad.items():
        for k in range(40):
            rows.append((i := i + 1, good if k == 0 else text, rule))
    rows += [(1000 + k, good, f"h{k % 20}") for k in range(400)] + [(2000, bad["symbols"], "once")]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for r in out.values():
        assert r.host_failed == (r.host if r.host in bad else "")
        assert r.kept == (not r.base_failed and r.host not in bad)
    assert not out[1].base_failed and out[2].host == "symbols" and not out[2].base_failed
    assert out[1].symbols_rate > 0.9 and out[1].repeated_lines_rate < 0.1 and 0 < out[2000].symbols_rate < 1


def test_lines_and_words_of_regular_strings_differ():
    """Thue and Morse's string and its complement, which polynomial hashes mod 2**64 take for one."""
    a = "a"
    while len(a) < 4096:
        a += a.translate({97: "b", 98: "a"})
    for n in (1024, 2048, 4096):
        x, y = a[:n], a[:n].translate({97: "b", 98: "a"})
        got = quality.measure(*tx.bytes_of(pa.array([f"{x}\n{y}", f"{x}\n{x}", f"{x} 1 2 {y} 1 2"])))
        assert got["n_dup_lines"].tolist() == [0, 1, 0] and got["n_repeat_words"].tolist() == [0, 0, 0]
        hashes, _ = tx.word_hashes(*tx.bytes_of(pa.array([f"{x} {y} {x}"])))
        assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_long_texts_and_clashing_columns(spark):
    text = "one two three\n" * 100_000
    df = spark.createDataFrame([(1, text, "h", 1, "n"), (1, text, "h", 1, "n")], "doc_id long, text string, source string, n_lines int, `a.b` string")
    assert [(r.n_words, r.n_dup_lines, r.n_repeat_words, r.kept) for r in quality.judge(df).collect()] == [(300_000, 99_999, 300_000, False)] * 2


def test_many_hosts_are_joined_as_few_are(spark, monkeypatch):
    rows = [(i, "bad" if i % 3 else " ".join(f"w{k}" for k in range(60)), f"h{i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, quality.judge(df).collect()))
    monkeypatch.setattr(quality, "FEW_HOSTS", 0)
    assert sorted(map(tuple, quality.judge(df).collect())) == want
