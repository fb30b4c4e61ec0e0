"""Secret scans: fixed patterns, and a randomness test battery for tokens that no pattern knows.

Every token of 20 or more characters, or each such part of it between '=' signs, gets an inferred encoding and three
tests of being uniformly random in it: a chi-squared test of the alphabet's use, a runs test about the alphabet's middle
and a serial-correlation test of neighbours. Their p-values are combined by Fisher's method. Random strings have uniform
p-values and tokens made of words small ones, the smaller the longer they are.

A report is a false discovery if the token is made of words. For each encoding and class of length over the whole
corpus, the high p-values tell how many tokens are words, and WORDS how many of these reach a p-value at that length.
Tokens are reported from the lowest p-value on at which the words expected there are within RATE of those reported. So
short tokens, for which the tests are weak, face a stricter cut, and a token alone in its stratum one of its own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import text as tx
from loomline.session import durable, ship

KINDS = ("assign", "access", "hex")
#: The fixed patterns of the base kinds, and how long a match (for assign: its value) must be.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Parts of a token that no encoding has all characters of: each split drops the characters of one family of base64.
PARTS = (re.compile(r"[A-Za-z0-9+/=]{20,}"), re.compile(r"[A-Za-z0-9_=-]{20,}"))
#: A name's or value's end within a token; padding at the token's end belongs to its last part.
BETWEEN = re.compile(r"=+(?!=|$)")
LEAST_VALUE, LEAST_ACCESS, LEAST_TOKEN = 6, 20, 20
MARK = "[SECRET]"

#: Encodings in the order in which they are tried: name and alphabet, in the order of its values.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("digits", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"), ("lower", _LOWER), ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_VALUES = [{ord(c): i for i, c in enumerate(alphabet)} for _, alphabet in ENCODINGS]
#: For the chi-squared test of short tokens the alphabet is pooled into cells, as counts of single characters would be too
#: small for it: digits, and the letters of either case that texts have often or seldom, and signs.
_OFTEN = "etaoinsrhld"
CELLS = 6
#: p-values are counted in so many equal bins. Above TAIL hardly any is of a word.
BINS, TAIL, RATE = 200, 0.5, 0.05
#: The shares of tokens made of words whose p-value is at LEVELS or above, by length_class (8: 20 to 22 characters, 9: to
#: 31, 10: to 45, 11: to 63, 12: longer). Measured on 64,000 identifiers, paths and names of words of eight styles.
LEVELS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5)
WORDS = {
    8: (0.225, 0.180, 0.136, 0.088, 0.055, 0.020, 0.006),
    9: (0.135, 0.104, 0.077, 0.047, 0.027, 0.0097, 0.0023),
    10: (0.055, 0.040, 0.026, 0.012, 0.006, 0.0014, 0.0002),
    11: (0.013, 0.0075, 0.005, 0.0018, 0.0009, 0.0003, 0.0001),
    12: (0.0016, 0.0006, 0.0002, 0.0001, 0.0001, 0.0001, 0.0001),
}
#: From so many high p-values on their number also tells how many tokens at any p-value are random.
MANY = 100


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: float) -> float:
    """P(chi-squared with k degrees >= x), by Wilson and Hilferty."""
    return 0.5 * math.erfc(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) / math.sqrt(2))


def encoding(body: str) -> int | None:
    """The place in ENCODINGS of the first one that has all characters."""
    letters = set(map(ord, body))
    return next((i for i, values in enumerate(_VALUES) if letters.issubset(values)), None)


def _cell(c: str) -> int:
    if c.isdigit():
        return 0
    return (1 if c.isupper() else 3) + (c.lower() not in _OFTEN) if c.isalpha() else 5


_IN = np.zeros(128, np.int64)  # a bit for each encoding that has the character
_VALUE = np.zeros((len(ENCODINGS), 128))
_SHARES = np.zeros((len(ENCODINGS), CELLS))
for _i, (_, _alphabet) in enumerate(ENCODINGS):
    for _v, _c in enumerate(_alphabet):
        _IN[ord(_c)] |= 1 << _i
        _VALUE[_i, ord(_c)] = _v
        _SHARES[_i, _cell(_c)] += 1 / len(_alphabet)
_SIZES = np.array([len(alphabet) for _, alphabet in ENCODINGS])
_CELL = np.array([_cell(chr(i)) for i in range(128)])
_KIND = np.array([1 if chr(i).isdigit() else 2 if chr(i).islower() else 4 if chr(i).isupper() else 8 for i in range(128)])


def batteries(tokens: list[str]) -> list[tuple[str, float] | None]:
    """battery() of each token, at once."""
    out: list[tuple[str, float] | None] = [None] * len(tokens)
    bodies = [t.rstrip("=") for t in tokens]
    own = [i for i, b in enumerate(bodies) if b and b.isascii()]
    if not own:
        return out
    raw = np.frombuffer("".join([bodies[i] for i in own]).encode(), np.uint8)
    n = np.array([len(bodies[i]) for i in own])
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    fits = np.bitwise_and.reduceat(_IN[raw], start)
    kinds = np.bitwise_or.reduceat(_KIND[raw], start)
    good = (fits > 0) & (kinds != 1) & (kinds != 2) & (kinds != 4)
    at = np.argmax(fits[:, None] & (1 << np.arange(len(ENCODINGS))) > 0, axis=1)
    token = np.repeat(np.arange(len(own)), n)
    x = _VALUE[at[token], raw]
    size = _SIZES[at]
    total = lambda v: np.add.reduceat(v, start)
    inner = np.append(token[1:] == token[:-1], False)

    cells = np.bincount(token * CELLS + _CELL[raw], minlength=len(own) * CELLS).reshape(-1, CELLS)
    wanted = _SHARES[at] * n[:, None]
    used = wanted > 0
    pooled = np.where(used, (cells - wanted) ** 2 / np.where(used, wanted, 1), 0).sum(axis=1)
    single = np.bincount(token * 64 + x.astype(np.int64), minlength=len(own) * 64).reshape(-1, 64).astype(float)
    whole = ((single**2).sum(axis=1) * size / n) - n
    enough = n >= 5 * size
    chi, freedom = np.where(enough, whole, pooled), np.where(enough, size, used.sum(axis=1)) - 1

    above = x >= size[token] / 2
    high = total(above.astype(np.int64))
    low = n - high
    changes = total((inner & (np.append(above[1:], False) != above)).astype(np.int64))
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / np.maximum(n - 1, 1)
    d = x - (total(x) / n)[token]
    power = total(d * d)
    neighbours = total(np.where(inner, d * np.append(d[1:], 0), 0))
    for k in np.flatnonzero(good).tolist():
        # Without both sides of the middle, or without any spread, a token isn't random.
        runs = (_normal_tail((1 + changes[k] - mean[k]) / math.sqrt(spread[k])) if spread[k] > 0 else 1.0) if high[k] and low[k] and n[k] > 2 else 0.0
        serial = _normal_tail((neighbours[k] / power[k] + 1 / n[k]) * math.sqrt(n[k])) if power[k] else 0.0
        t = -sum(math.log(max(p, 1e-15)) for p in (_chi_tail(chi[k], freedom[k]), runs, serial))
        out[own[k]] = ENCODINGS[at[k]][0], math.exp(-t) * (1 + t + t * t / 2)
    return out


def battery(token: str) -> tuple[str, float] | None:
    """(encoding, combined p-value of being random in it); None if no encoding has all the characters, or if
    the token is of digits alone or of letters in one case alone, which no secret format uses."""
    return batteries([token])[0]


def length_class(n: int) -> int:
    """Powers of the square root of two."""
    return int(2 * math.log2(n))


def parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the token's parts that the battery tests. A token is split at each inner '='. A part that mixes
    the signs of both kinds of base64 is split at each kind's in turn: such pieces may overlap, and each is decided by
    itself."""
    out = []
    edges = [start, *(x for m in BETWEEN.finditer(text[start:end]) for x in (start + m.start(), start + m.end())), end]
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        if z - a >= LEAST_TOKEN:
            whole = encoding(text[a:z].rstrip("=")) is not None
            out += [(a, z)] if whole else [m.span() for p in PARTS for m in p.finditer(text, a, z)]
    return sorted(out)


def tested(text: str, start: int, end: int) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p-value) of the token's parts."""
    spans = parts(text, start, end)
    return [(u, v, *r) for (u, v), r in zip(spans, batteries([text[u:v] for u, v in spans]), strict=True) if r]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(texts: list[str | None]) -> list[tuple[list, list]]:
    """For each text its base spans and (start, end, stratum, bin) of the tokens that the battery tested beside them."""
    out, places = [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        out.append((base, []))
        reach = list(accumulate((z for _, _, z in base), max))
        for m in TOKEN.finditer(text) if text else ():
            for u, v in parts(text, *m.span()):
                k = bisect_right(reach, u)  # the first base span that goes beyond the part's start
                if k == len(base) or base[k][0] >= v:
                    places.append((i, u, v))
    for (i, u, v), r in zip(places, batteries([texts[i][u:v] for i, u, v in places]), strict=True):
        if r:
            out[i][1].append((u, v, f"{r[0]}:{length_class(v - u)}", min(int(r[1] * BINS), BINS - 1)))
    return out


def cuts(counted: Iterable[tuple[str, int, int]], rate: float = RATE) -> dict[str, int]:
    """(stratum, bin, tokens) over all documents -> the lowest bin from which a stratum's tokens are reported: the first
    of LEVELS at which the words expected there, by their number in the stratum and WORDS at its length, are at most
    `rate` of the tokens there. Where high p-values are MANY, those above what random tokens explain must be as few."""
    by: dict[str, np.ndarray] = {}
    for stratum, b, n in counted:
        by.setdefault(stratum, np.zeros(BINS))[b] += n
    out = {}
    for stratum, hist in by.items():
        kind = stratum.rpartition(":")[2]
        shares = WORDS[min(max(int(kind), min(WORDS)), max(WORDS)) if kind.isdigit() else min(WORDS)]
        high = hist[int(BINS * TAIL) :].sum()
        random = high / (1 - TAIL)
        words = max(hist.sum() - random, 0.0)
        for level, share in zip(LEVELS, shares, strict=True):
            found = hist[round(BINS * level) :].sum()
            excess = found - (1 - level) * random if high >= MANY else 0.0
            if found and max(words * share, excess) <= rate * found:
                out[stratum] = round(BINS * level)
                break
    return out


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_MORE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("bin", pa.int32())]))
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _base_list(spans) -> list[dict]:
    return [{"start": a, "kind": k, "end": z} for a, k, z in spans]


def _scan_task(batches):
    """(doc_id, text) -> doc_id, base and the tested tokens of each text."""
    for batch, _, _ in tx.blocks(batches, "text"):
        found = scan(batch.column(1).to_pylist())
        more = [[{"start": u, "end": v, "stratum": s, "bin": b} for u, v, s, b in own] for _, own in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_base_list(x) for x, _ in found], _BASE), pa.array(more, _MORE)], ["doc_id", "base", "more"])


def _count_task(batches):
    for batch, _, _ in tx.blocks(batches, "text"):
        found = Counter((s, b) for _, own in scan(batch.column(0).to_pylist()) for _, _, s, b in own)
        rows = [(s, b, n) for (s, b), n in sorted(found.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["stratum", "bin", "n"])


def _span_task(column: str, least: dict[str, int], masked: bool):
    """Batches with the text as it is searched, or masked, and its spans."""

    def run(batches):
        for batch, _, _ in tx.blocks(batches, column):
            at = batch.schema.get_field_index(column)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            spans = [sorted(base + [(u, 3, v) for u, v, s, b in own if b >= least.get(s, BINS)]) for base, own in scan(texts)]
            if masked:
                texts = [mask(t, s) for t, s in zip(texts, spans, strict=True)]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([_base_list(x) for x in spans], _BASE)], [*batch.schema.names, "spans"])

    return run


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans, given by start, replaced by MARK."""
    done, out = 0, []
    for a, _, z in spans:
        if a >= done:
            out += [text[done:a], MARK]
        done = max(done, z)
    return "".join([*out, text[done:]])


def _found(docs: DataFrame, column: str, masked: bool) -> DataFrame:
    """Two scans and no copy of the texts: the first counts the strata, which are bounded in number (encodings times
    classes of length); the second applies their cuts."""
    ship(docs.sparkSession)
    held, (text,) = tx.positional(docs, column)
    held = held.withColumn(text, F.col(text).cast("string"))
    counted = held.select(text).toDF("text").mapInArrow(_count_task, "stratum string, bin int, n long").groupBy("stratum", "bin").agg(F.sum("n").alias("n"))
    least = cuts(tuple(r) for r in counted.collect())
    schema = T.StructType([*held.schema.fields, T.StructField("spans", T.DataType.fromDDL(_SPANS))])
    return held.mapInArrow(_span_task(text, least, masked), schema)


def find_secrets(docs: DataFrame, column: str = "text", spans: str = "spans") -> DataFrame:
    """docs(column, ...) -> docs' columns, the text as a string, and spans: an array of (start, kind, end) in code points,
    end exclusive, kinds numbered as KINDS and then 3 for the battery's, by start.

    Spans of the battery never overlap base ones; those of a token's pieces may overlap each other. Null text: empty,
    with no spans. Each row gives a row, repeated ones and null ids too; no rows give no rows. A very long text is
    searched as a whole. A column of docs that is named like spans is replaced; others stay, whatever their names.
    """
    found = _found(docs, column, False)
    kept = [i for i, n in enumerate(docs.columns) if n.lower() != spans.lower()]
    return found.select(*[f"c{i}" for i in kept], "spans").toDF(*[docs.columns[i] for i in kept], spans)


def mask_secrets(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with each run of overlapping spans in the text replaced by MARK; other columns stay as they are, whatever
    their names. Null text becomes empty; each row gives a row; no rows give no rows."""
    return _found(docs, column, True).drop("spans").toDF(*docs.columns)


def _joined(spans, kinds=(*KINDS, "random")):
    name = F.array(*[F.lit(k) for k in kinds])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def span_report(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs(doc_id, column, ...) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans. One scan, whose finds are
    written without the texts until all strata are counted. Null text: empty, with no spans; each row gives a row, and
    no rows none; other columns are not read."""
    ship(docs.sparkSession)
    schema = f"doc_id long, base {_SPANS}, more array<struct<start:int,end:int,stratum:string,bin:int>>"
    scanned = durable(tx.slim(docs, column).mapInArrow(_scan_task, schema), "scanned")
    counted = scanned.select(F.explode("more").alias("m")).groupBy("m.stratum", "m.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    at = cuts(tuple(r) for r in counted)
    least = F.create_map(*[F.lit(x) for kv in at.items() for x in kv]) if at else F.create_map().cast("map<string,int>")
    own = F.filter("more", lambda m: m["bin"] >= F.coalesce(F.try_element_at(least, m["stratum"]), F.lit(BINS)))
    added = F.transform(own, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", added))).alias("spans"))
