import itertools
import random
import re

import pytest

from loomline.llm import private as pr

KEY = b"a key of tests"

VALID = {
    "card": ["4111 1111 1111 1111", "4380412818073016", "5500-0000-0000-0004", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "date": ["2024-02-29", "31/12/1999", "12/31/1999", "01.05.2020"],
    "ipv4": ["70.123.182.155", "8.8.8.8"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (988) 555-2485", "+44 20 7946 0958", "030 1234 5678", "+4915112345678"],
    "email": ["hoccrcif.96@mail8.example.com", "a@b.co"],
}


def test_feistel_is_a_permutation_and_turns_back():
    out = [pr.feistel(v, 7, 13, b"k", "t") for v in range(91)]
    assert sorted(out) == list(range(91)) and out != list(range(91))
    assert [pr.feistel(v, 7, 13, b"k", "t", True) for v in out] == list(range(91))
    assert out != [pr.feistel(v, 7, 13, b"other", "t") for v in range(91)]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALID.items() for v in vs])
def test_pseudonyms_keep_format_and_turn_back(kind, value):
    new, spans = pr.replace(f"x {value} y", KEY)
    assert spans == [(kind, 2, 2 + len(value))]
    new = new[2:-2]
    assert new != value and pr.pseudonym(kind, new, KEY, back=True) == value
    if kind != "ipv4":
        shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
        assert shape(new) == shape(value)
    assert [k for k, _, _ in pr.replace(new, KEY)[1]] == [kind]


def test_small_formats_are_permuted_without_clashes():
    values = [f"{a:03d}-{b:02d}-0001" for a, b in itertools.product(range(1, 40), range(1, 30))]
    out = {pr.pseudonym("ssn", v, KEY) for v in values}
    assert len(out) == len(values) and all(pr._is_ssn(v) for v in out)
    days = [f"2020-01-{d:02d}" for d in range(1, 32)]
    assert len({pr.pseudonym("date", d, KEY) for d in days}) == 31


@pytest.mark.parametrize("text", ["4111111111111112", "1.2.3.999", "2023-02-29", "000-12-3456", "DE88 3704 0044 0532 0130 00", "12345", "v1.2.3", "no digits", "", "a@b"])
def test_invalid_values_stay(text):
    assert pr.replace(text, KEY) == (text, [])


def test_random_texts_turn_back():
    rnd = random.Random(6)
    for _ in range(200):
        values = [rnd.choice(VALID[rnd.choice(list(VALID))]) for _ in range(3)]
        text = f"é {values[0]} 🙂 {values[1]}, and {values[2]} end"
        new, spans = pr.replace(text, KEY)
        assert len(spans) == 3 and pr.replace(new, KEY, back=True)[0] == text
        assert not any(v in new for v in values)


def test_equal_values_stay_linked_across_documents(spark, docs, empty):
    rows = [(1, "call +1 (988) 555-2485 now", 1), (2, "or +1 (988) 555-2485", 2), (3, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    out = {r.doc_id: r for r in pr.report(df, KEY).collect()}
    a, b = (re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[i].text)[0] for i in (1, 2))
    assert a == b != "+1 (988) 555-2485" and out[3].text == "" and out[3].n_found == 0 and out[1].n_phone == 1
    whole = pr.pseudonymize(df, KEY)
    assert set(whole.columns) == {"doc_id", "text", "spans"}
    assert pr.report(docs, KEY).count() == docs.count() and pr.report(empty, KEY).count() == 0
