"""Secrets within longer tokens, and those without a digit."""

import random
import string

from loomline.llm import secrets

BASE62 = string.ascii_letters + string.digits


def test_values_beside_names_and_in_paths_are_reported_and_masked(spark):
    rnd = random.Random(3)
    rows, keys = [], []
    for i in range(240):
        make = ("AWS_SECRET_ACCESS_KEY={}", "session_id={}", "a={}=b", "/srv/my_app-keys/{}", "my_own-name/{}/x+y", "{}")[i % 6]
        signs = {3: BASE62 + "_-", 4: BASE62 + "_-"}.get(i % 6, BASE62 + "+/" if i % 2 else BASE62)
        keys.append("".join(rnd.choices(signs if i % 6 != 5 else string.ascii_letters, k=40)))
        rows.append((i, "set " + make.format(keys[-1]) + " here"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.span_report(df).collect()}
    masked = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    for kind in range(6):
        own = [(i, t, k) for (i, t), k in zip(rows, keys, strict=True) if i % 6 == kind]
        found = lambda i: [tuple(map(int, s.split(":")[1:])) for s in spans[i].split(",") if s.startswith("random")]
        caught = [i for i, t, k in own if any(a <= t.index(k) and t.index(k) + len(k) <= z for a, z in found(i))]
        assert len(caught) >= 0.85 * len(own), (kind, len(caught))
        assert all(k not in masked[i] and secrets.MARK in masked[i] for i, _, k in own if i in caught)


def test_only_digits_alone_and_letters_of_one_case_are_skipped():
    assert secrets.battery("Zk" * 12) and secrets.battery("QwErTyUiOpAsDfGhJkLz")
    assert not any(secrets.battery(t) for t in ("1" * 24, "abcdefghijklmnopqrstuvwx", "ABCDEFGHIJKLMNOPQRSTUVWX", "=" * 24))


def test_parts_of_a_token():
    name, key = "my_name_is_long_enough_here", "Zk3qP0xW8vT5bY2nM7cR4dF6"
    text = f"x {name}={key}== y"
    assert [(text[a:z], e) for a, z, e, _ in secrets.tested(text, 2, len(text) - 2)] == [(name, "base64url"), (key + "==", "base62")]
    text = "some/path_of+" + key
    found = secrets.tested(text, 0, len(text))
    assert any(text[a:z].endswith(key) for a, z, *_ in found)


def test_a_token_alone_in_its_stratum_is_decided_by_its_own_p_value():
    at = lambda p: int(p * secrets.BINS)
    counted = [("alone", at(0.3), 1), ("word", 0, 1), ("weak", at(0.05), 1), ("few", at(0.3), 2), ("few", at(0.7), 1), ("few", 0, 5),
        ("words", 0, 990), ("words", at(0.3), 10)]
    cut = secrets.cuts(counted)
    assert cut["alone"] <= at(0.3) and cut["few"] <= at(0.3)
    assert not {"word", "weak", "words"} & set(cut)


def test_rare_formats_are_reported_whatever_else_the_corpus_holds():
    rnd = random.Random(12)
    reported = 0
    for _ in range(300):
        _, p = secrets.battery("".join(rnd.choices(BASE62, k=40)))
        b = min(int(p * secrets.BINS), secrets.BINS - 1)
        reported += secrets.cuts([("rare", b, 1)]).get("rare", secrets.BINS) <= b
    assert reported >= 0.7 * 300
