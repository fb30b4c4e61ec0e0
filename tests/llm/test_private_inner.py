"""Valid values within or before what fails as a whole."""

import pytest

from loomline.llm import private as pr

KEY = b"a key of tests"

CARD, IBANS = "4111 1111 1111 1111", ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "LC55 HEMM 0001 0001 0012 0012 0002 3015", "BE68539007547034"]
# 24 characters of a country without a known length
OTHER = next(t for n in range(2, 99) if pr._mod97((t := f"ZZ{n:02d} 1234 5678 9012 3456 7890").replace(" ", "")) == 1)


@pytest.mark.parametrize("iban", [*IBANS, OTHER])
@pytest.mark.parametrize("after", ["", " EUR", " BIC", " A", " PAID", " PAID EUR", " 12", ", EUR"])
def test_words_after_an_iban_leave_it_valid(iban, after):
    text = f"to {iban}{after}"
    new, spans = pr.replace(text, KEY)
    assert spans == [("iban", 3, 3 + len(iban))]
    assert new.endswith(after) and iban not in new and new[: 3 + len(iban)] == pr.replace(f"to {iban}", KEY)[0]
    assert pr.replace(new, KEY, back=True)[0] == text


@pytest.mark.parametrize(("text", "kind", "value"), [
    (f"XX00 ABCD EFGH {IBANS[0]}", "iban", IBANS[0]),
    (f"{IBANS[0][:-1]}5 {IBANS[1]}", "iban", IBANS[1]),
    (f"ref AB12 {CARD}", "card", CARD),
    (f"1 {CARD}", "card", CARD),
    ("ref AB12 CDEF GHIJ 030 1234 5678", "phone", "030 1234 5678"),
    ("DE88 3704 0044 0532 0130 00 030 1234 5678", "phone", "030 1234 5678"),
])
def test_valid_values_within_failed_matches_are_found(text, kind, value):
    at = text.index(value)
    new, spans = pr.replace(text, KEY)
    assert spans == [(kind, at, at + len(value))] and value not in new


@pytest.mark.parametrize("text", ["300.123.182.155", "GB83 WEST 1234 5698 7654 32", "000-12-3456", "31.02.2024"])
def test_rests_of_failed_matches_are_no_phone_numbers(text):
    assert pr.replace(text, KEY) == (text, [])
