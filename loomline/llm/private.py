"""Pseudonyms for private data that keep its format.

Numbers, addresses and dates are found by pattern and validated by their own rules (check digits, ranges, calendar).
Their value, without separators and case, is permuted by a keyed Feistel network over exactly the values of its format,
and written as the value was. So a pseudonym is valid too, equal values get equal pseudonyms in all documents however
they are written, different ones different pseudonyms, and the key's holder can reverse it. Values that a rule forbids
are walked over: the permutation is applied again until its value is allowed.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import text as tx
from loomline.session import ship

ROUNDS = 10
#: The session setting that names the key of queries.
KEY_SETTING = "spark.loomline.pseudonym.key"
KINDS = ("email", "iban", "date", "ipv4", "ssn", "phone", "card")
#: The patterns of the kinds; of overlapping finds the leftmost stays, then the first kind listed.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,16}[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}(?:[ .-][0-9]{2,5}){1,3}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
_CARD, _PHONE = re.compile(PATTERNS["card"]), re.compile(PATTERNS["phone"])
#: How long the account numbers of countries are.
_IBAN_LENGTHS = dict(re.findall("([A-Z]{2})([0-9]{2})", """
    AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23
    GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18
    NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"""))
#: Country codes of two digits.
_TWO_DIGIT_CODES = """20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66
    81 82 84 86 90 91 92 93 94 95 98""".split()
_HINT = re.compile("[0-9@]")
_LETTERS, _CAPITALS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "|".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def feistel(value: int, left: int, right: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(left * right): rounds add a digest of one half to the other, each in its range."""
    a, b = divmod(value, right)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2:
            b = (b + sign * _digest(key, tweak, i, a)) % right
        else:
            a = (a + sign * _digest(key, tweak, i, b)) % left
    return a * right + b


def permute(text: str, key: bytes, tweak: str, back: bool = False, allowed=None) -> str:
    """Letters and digits of a text replaced within their class; all else stays. allowed: which results may be."""
    sets = [next((s for s in (_DIGITS, _LETTERS, _CAPITALS) if c in s), None) for c in text]
    own = [(i, s) for i, s in enumerate(sets) if s]
    if not own:
        return text
    half = len(own) // 2
    sizes = [1, 1]
    for k, (_, s) in enumerate(own):
        sizes[k >= half] *= len(s)
    count = sizes[0] * sizes[1]
    if half == 0:  # one symbol has no halves: a square that holds all its values
        sizes = [math.isqrt(count - 1) + 1] * 2
    value = 0
    for i, s in own:
        value = value * len(s) + s.index(text[i])
    shape = tweak + ":" + "".join(s[0] if s else c for c, s in zip(text, sets, strict=True))
    while True:
        value = feistel(value, sizes[0], sizes[1], key, shape, back)
        if value >= count:
            continue
        out, rest = list(text), value
        for i, s in reversed(own):
            rest, at = divmod(rest, len(s))
            out[i] = s[at]
        if allowed is None or allowed("".join(out)):
            return "".join(out)


def luhn(digits: str) -> int:
    """The sum of a card number's digits, every second from the right doubled; valid if it ends in 0."""
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _fill(shape: str, symbols: str) -> str:
    """symbols in the places of shape's letters and digits."""
    rest = iter(symbols)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


_WRITTEN = {"-": "{y:04d}-{m:02d}-{d:02d}", ".": "{d:02d}.{m:02d}.{y:04d}", "m/": "{m:02d}/{d:02d}/{y:04d}", "d/": "{d:02d}/{m:02d}/{y:04d}"}


def _day(text: str) -> tuple[datetime.date, str] | None:
    """A calendar day and its format; ambiguous days with slashes are month first unless that is no day."""
    try:
        if "-" in text:
            return datetime.date(*map(int, text.split("-"))), "-"
        a, b, y = map(int, re.split(r"[./]", text))
        if "." in text:
            return datetime.date(y, b, a), "."
        return (datetime.date(y, a, b), "m/") if a <= 12 else (datetime.date(y, b, a), "d/")
    except ValueError:
        return None


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub("[ -]", "", text)
    if luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = permute(digits[:-1], key, "card", back, lambda t: len(set(t)) > 1)
    return _fill(text, body + str(-luhn(body + "0") % 10))


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = permute(plain[4:], key, "iban" + plain[:2], back)
    return _fill(text, f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02d}{body}")


def _date(text: str, key: bytes, back: bool) -> str | None:
    found = _day(text)
    if not found or not _FIRST <= found[0].toordinal() <= _LAST:
        return None
    value = found[0].toordinal() - _FIRST
    count = _LAST - _FIRST + 1
    side = int(count**0.5) + 1

    late = found[0].day > 12  # days to the 12th stay so: with slashes and the day first they would read as months
    while True:
        value = feistel(value, side, side, key, "date", back)
        if value < count and (datetime.date.fromordinal(value + _FIRST).day > 12) == late:
            y, m, d = datetime.date.fromordinal(value + _FIRST).timetuple()[:3]
            return _WRITTEN[found[1]].format(y=y, m=m, d=d)


def _ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 16, 1 << 16, key, "ipv4", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _is_ssn(t: str) -> bool:
    return t[:3] not in ("000", "666") and t[0] != "9" and t[4:6] != "00" and t[7:] != "0000"


def _country(digits: str) -> str:
    """The country code that begins an international number: one, two or else three digits."""
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in _TWO_DIGIT_CODES else digits[:3]


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    if not (8 if text[0] == "+" else 9) <= len(digits) <= 15:
        return None
    head = _country(digits) if text[0] == "+" else ""
    body = digits[len(head) :]
    low = body[0] in "01"
    return _fill(text, head + permute(body, key, "phone" + head, back, lambda t: (t[0] in "01") == low))


def _email(text: str, key: bytes, back: bool) -> str | None:
    name, domain = text.rsplit("@", 1)
    new = permute(name.lower(), key, "email", back)
    return "".join(n.upper() if c.isupper() else n for n, c in zip(new, name, strict=True)) + "@" + domain


_RULES = {
    "email": _email, "iban": _iban, "date": _date, "ipv4": _ipv4, "phone": _phone, "card": _card,
    "ssn": lambda t, key, back: permute(t, key, "ssn", back, _is_ssn) if _is_ssn(t) else None,
}


def _iban_ends(text: str) -> list[int]:
    """Where an account number that begins a match may end, as words after it match too: first the end that gives its
    country's length, then the longer ones first."""
    ends = [len(text), *(m.start() for m in reversed([*re.finditer(" ", text)]))]
    own = int(_IBAN_LENGTHS.get(text[:2], 0))
    return sorted(ends, key=lambda z: len(text[:z].replace(" ", "")) != own)


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value of a kind (with back: the value of a pseudonym); None if it isn't valid."""
    return _RULES[kind](text, key, back)


def _is_rest(text: str, failed: int, end: int, key: bytes) -> bool:
    """Whether a phone number found within a failed match is only the rest of it: it ends there too, or another one
    begins right behind. Phone numbers have no check digits, so parts of any longer number look like one."""
    after = _PHONE.search(text, failed, end + 64)  # longer than any number
    return end <= failed or bool(after and after.start() < end and pseudonym("phone", after[0], key) is not None)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with all valid values replaced, and their (kind, start, end) in the text as it came."""
    if not _HINT.search(text):
        return text, []
    parts, spans, done, at, failed = [], [], 0, 0, 0
    while m := _FIND.search(text, at):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "iban":
            new, end = next(((new, start + z) for z in _iban_ends(m[0]) if (new := pseudonym(kind, m[0][:z], key, back)) is not None), (None, end))
        else:
            rest = kind == "phone" and start < failed and _is_rest(text, failed, end, key)
            new = None if rest else pseudonym(kind, m[0], key, back)
        if new is None and kind == "phone" and not (rest and end > failed):  # groups of digits may be a card, or a number may begin further on
            n = _CARD.match(text, start)
            if n and (new := pseudonym("card", n[0], key, back)) is not None:
                kind, end = "card", n.end()
        if new is None:
            if kind != "phone":
                failed = max(failed, end)
            at = start + 1
            continue
        parts += [text[done:start], new]
        spans.append((kind, start, end))
        done = at = end
    return "".join([*parts, text[done:]]) if spans else text, spans


def _task(key: bytes, back: bool, column: str):
    def run(batches):
        for batch, _, _ in tx.blocks(batches, column):
            at = batch.schema.get_field_index(column)
            found = [replace(t or "", key, back) for t in batch.column(at).to_pylist()]
            texts = pa.array([t for t, _ in found], pa.string())
            spans = pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in s] for _, s in found], _SPANS)
            yield pa.RecordBatch.from_arrays([*[texts if i == at else c for i, c in enumerate(batch.columns)], spans], [*batch.schema.names, "spans"])

    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def pseudonymize(docs: DataFrame, key: bytes, column: str = "text", back: bool = False, spans: str = "spans") -> DataFrame:
    """docs(column, ...) -> docs' columns, with the text as rewritten, and spans: an array of (kind, start, end) in code
    points of the text as it came, end exclusive.

    One pass without a shuffle: pseudonyms depend on value, format and key alone. The key is not to be empty. Null text:
    empty. Each row gives a row, repeated ones and null ids too; no rows give no rows; a very long text is searched as a
    whole, in time that grows with its length. A column of docs that is named like spans is replaced; others stay,
    whatever their names. With back, pseudonyms turn into their values again.
    """
    if not key:
        raise ValueError("a key is wanted")
    ship(docs.sparkSession)
    held, (text,) = tx.positional(docs, column)
    held = held.withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*held.schema.fields, T.StructField("spans", T.DataType.fromDDL("array<struct<kind:string,start:int,end:int>>"))])
    found = held.mapInArrow(_task(key, back, text), schema)
    kept = [i for i, n in enumerate(docs.columns) if n.lower() != spans.lower()]
    return found.select(*[f"c{i}" for i in kept], "spans").toDF(*[docs.columns[i] for i in kept], spans)


def key_of(spark: SparkSession) -> bytes:
    """The key that the session names in KEY_SETTING. Where it names none, a random one that this application makes once
    and tells no one: pseudonyms then are linked within it and can't be reversed."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()
    own = getattr(key_of, "own", None)
    if not own or own[0] != spark.sparkContext.applicationId:
        key_of.own = own = spark.sparkContext.applicationId, os.urandom(32)
    return own[1]


def report(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """docs(doc_id, column, ...) -> doc_id, n_found, a count of each kind, spans as text, and the rewritten text. Nulls,
    long texts, repeated rows and empty tables are as in pseudonymize(); other columns are not read."""
    found = pseudonymize(tx.slim(docs, column), key)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    named = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", F.size("spans").cast("long").alias("n_found"), *[count(k) for k in KINDS], named.alias("spans"), "text")
