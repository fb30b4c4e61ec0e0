"""Vectorised text primitives over Arrow batches: blocks of whole texts, word and shingle hashes.

All work is on flat numpy arrays of a block of texts, so a Python call is paid per block and not per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_MIX = [U64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
#: One odd factor for each place in a shingle.
PLACES = [U64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U64(33))
    h *= _MIX[0]
    h ^= h >> U64(29)
    h *= _MIX[1]
    h ^= h >> U64(32)
    return h


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[raw]


class Powers:
    """Powers of BASE and of its inverse mod 2**64, grown as longer blocks ask for them."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", BASE), ("down", BASE_INV)):
                steps = np.full(max(n, 1 << 16), base, U64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the polynomial hash of values[i:j], times BASE**i."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * Powers.of(len(values))[0], out=out[1:])
    return out


def spans_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] from their prefix(), alike for equal content anywhere."""
    return mix((c[end] - c[start]) * Powers.of(len(c))[1][start])


#: A random word for each byte at each of a piece's first 256 places.
_PLACED = mix(np.arange(1, (1 << 16) + 1, dtype=U64) * PLACES[0])


def content_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:end] for pieces that don't overlap: sums of a random word for each byte at its place. Unlike a
    polynomial mod 2**64 this has no structure that regular strings (like Thue and Morse's) could cancel out."""
    n = end - start
    at = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], n)
    key = (place << 8 | raw[np.repeat(start, n) + place]).astype(U64)
    words = _PLACED[(key & U64(0xFFFF)).astype(np.int64)]
    far = np.flatnonzero(place >= 256)
    if len(far):
        words[far] = mix(key[far] * PLACES[1] + U64(1))
    return mix(reduce_at(np.add, words, at, 0) + n.astype(U64) * PLACES[2])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and len + 1 offsets; null texts are empty."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def positional(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """docs with columns named c0, c1, ... by position, so that no name clashes with another or with a new one, and the
    new names of the wanted columns: an exact match, else the one that differs in case only."""
    names, found = docs.columns, []
    for w in wanted:
        at = [i for i, n in enumerate(names) if n == w] or [i for i, n in enumerate(names) if n.lower() == w.lower()]
        if len(at) != 1:
            raise ValueError(f"one column {w} is wanted, not {len(at)}")
        found.append(f"c{at[0]}")
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), found


def slim(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id as a long and text as a string, whatever else docs has."""
    held, (own, text) = positional(docs, key, column)
    return held.select(F.col(own).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def trim() -> None:
    """Give a task's freed memory back; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with whole texts of about limit bytes (one text at least), with bytes_of(column)."""
    for batch in batches:
        if not len(batch):
            continue
        raw, at = bytes_of(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), raw[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j
        del batch, raw, at
    trim()


def word_bounds(raw: np.ndarray, at: np.ndarray, parts: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ (or of what stands between the bytes that
    parts marks) of all texts, and for each text the number of its first word (len + 1 values)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~parts[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return start, end, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True, parts: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, with A-Z lower-cased if so asked, and for each text the number of its first word."""
    start, end, first = word_bounds(raw, at, parts)
    return content_hash(_LOWER[raw] if lower else raw, start, end), first


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's shingles of so many words (the whole of a shorter text as one), and len + 1 offsets."""
    n = len(words)
    count = np.diff(first)
    left = np.repeat(first[1:], count) - np.arange(n)
    padded = np.concatenate([words, np.zeros(size, U64)])
    total = np.zeros(n, U64)
    for j in range(size):
        total += np.where(left > j, padded[j : j + n] * PLACES[j % 5] + U64(j * j), U64(0))
    short = (count > 0) & (count < size)
    keep = left >= size
    keep[first[:-1][short]] = True
    total = mix(total + np.minimum(left, size).astype(U64) * _MIX[0])
    return total[keep], np.concatenate([[0], np.cumsum(np.where(count >= size, count - size + 1, short))]).astype(np.int64)


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, once each, and len + 1 offsets."""
    parts = [np.unique(values[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    return np.concatenate(parts) if parts else values[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def reduce_at(ufunc: np.ufunc, values: np.ndarray, at: np.ndarray, empty) -> np.ndarray:
    """ufunc over each text's values; empty for texts that have none."""
    out = np.full(len(at) - 1, empty, values.dtype)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        out[some] = ufunc.reduceat(values, at[:-1][some])
    return out


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
