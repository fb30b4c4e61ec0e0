"""What the false-discovery control reports: random tokens, alone in their stratum too, and few that are made of words."""

import random
import string
import time

import pytest

from loomline.llm import secrets

BASE62 = string.ascii_letters + string.digits
WORDS = """request response handler config service user account session value number index total payment order customer
update delete create select insert table column parser writer reader buffer stream cluster node worker manager""".split()


def reported(tokens):
    """How many of the tokens are reported, as the whole corpus."""
    found = [(f"{r[0]}:{secrets.length_class(len(t))}", min(int(r[1] * secrets.BINS), secrets.BINS - 1)) for t in tokens if (r := secrets.battery(t))]
    cut = secrets.cuts((s, b, 1) for s, b in found)
    return sum(b >= cut.get(s, secrets.BINS) for s, b in found)


def identifier(rnd):
    words = rnd.choices(WORDS, k=rnd.randrange(4, 8))
    return rnd.choice([lambda: "".join(map(str.capitalize, words)), lambda: "_".join(words) + str(rnd.randrange(10)), lambda: "-".join(words),
        lambda: "/".join(w.capitalize() for w in words)])()


@pytest.mark.parametrize("together", [1, 3])
def test_lone_random_tokens_are_reported(together):
    rnd = random.Random(together)
    found = sum(reported(["".join(rnd.choices(BASE62, k=n)) for _ in range(together)]) for n in [rnd.randrange(24, 65) for _ in range(400)])
    assert found >= 0.9 * 400 * together


def test_false_discoveries_stay_within_the_rate():
    rnd = random.Random(5)
    false = true = 0
    for _ in range(300):
        words = [identifier(rnd) for _ in range(rnd.randrange(1, 30))]
        keys = ["".join(rnd.choices(BASE62, k=rnd.choice([24, 32, 40]))) for _ in range(rnd.randrange(3))]
        found = [(t in keys, f"{r[0]}:{secrets.length_class(len(t))}",
            min(int(r[1] * secrets.BINS), secrets.BINS - 1)) for t in words + keys if (r := secrets.battery(t))]
        cut = secrets.cuts((s, b, 1) for _, s, b in found)
        hits = [key for key, s, b in found if b >= cut.get(s, secrets.BINS)]
        true, false = true + sum(hits), false + len(hits) - sum(hits)
    assert true > 200 and false <= secrets.RATE * (true + false)


def test_batteries_equal_single_ones():
    rnd = random.Random(6)
    tokens = ["".join(rnd.choices(signs, k=rnd.randrange(20, 400))) for signs in (BASE62, "01", "abcdef019", BASE62 + "+/", "é" + BASE62,
        BASE62 + "_-") for _ in range(20)] + ["", "=" * 30, "1" * 30]
    assert secrets.batteries(tokens) == [secrets.battery(t) for t in tokens] and secrets.batteries([]) == []


def test_long_texts_and_clashing_columns(spark):
    key = "".join(random.Random(2).choices(BASE62, k=40))
    text = "password=abcdef1 " * 20_000 + "x" * 1_000_000 + " " + key
    began = time.monotonic()
    base, more = secrets.scan([text])[0]
    assert len(base) == 20_000 and [(u, v) for u, v, _, _ in more] == [(len(text) - len(key), len(text))] and time.monotonic() - began < 10
    df = spark.createDataFrame([(1, f"a {key} b", "v", 2, 3, 4), (1, f"a {key} b", "v", 2, 3, 4), (None, None, None, None, None, None)],
        "doc_id long, text string, `a.b` string, __spans int, c1 int, more int")
    out = [tuple(r) for r in secrets.mask_secrets(df).collect()]
    assert secrets.mask_secrets(df).columns == df.columns
    assert sorted(out, key=str) == sorted([(1, "a [SECRET] b", "v", 2, 3, 4)] * 2 + [(None, "", None, None, None, None)], key=str)
    assert secrets.find_secrets(df, spans="C1").columns == ["doc_id", "text", "a.b", "__spans", "more", "C1"]
