"""Benchmark decontamination by q-gram lemma filtering.

An occurrence of an item of m characters with at most e edits shares at least m - q + 1 - q * e of the item's q-grams
with the text, on diagonals at most e apart. Hits of the item's q-grams in a text are counted in diagonal bands of
width 2 * e + 2 that overlap by half, so every such set of diagonals lies in one band. Only bands that reach the bound
are kept, and a banded alignment verifies them. Items too short to have a q-gram are looked up as they are.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm import text as tx
from loomline.session import ship

Q = 8
#: Edits that an occurrence may have, as a share of the item's characters.
EDITS = 0.08
#: Characters of benchmark items that one pass holds; more items take more passes.
PASS_CHARS = 4_000_000
_HASH_BITS = 22


def codes(text: str) -> np.ndarray:
    """Code points, with A-Z lower-cased and every white space alike."""
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    upper = (x >= 65) & (x <= 90)
    x[upper] += 32
    x[(x >= 9) & (x <= 13)] = 32
    return x


_IN_WORD = np.array([chr(i).isalnum() for i in range(128)] + [True])


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    wide = x.astype(np.uint64)
    for i in range(q):
        h *= np.uint64(0x100000001B3)
        h += wide[i : i + n]
    return tx.mix(h)


def budget(m: int) -> int:
    """Edits allowed: EDITS of the length, as far as the q-gram bound stays positive."""
    return max(0, min(int(m * EDITS), (m - Q) // Q))


class Index:
    """q-grams of a pass's items, sorted, with a bitmap that most grams of a text miss."""

    def __init__(self, items: list[tuple[int, str]]):
        self.short: dict[int, dict[bytes, list[int]]] = {}  # by length
        for i, t in items:
            x = codes(t)
            if 0 < len(x) < Q:
                self.short.setdefault(len(x), {}).setdefault(x.tobytes(), []).append(i)
        items = [(i, t) for i, t in items if len(t) >= Q]
        self.ids = [i for i, _ in items]
        self.codes = [codes(t) for _, t in items]
        found = [grams(x) for x in self.codes]
        owner = np.repeat(np.arange(len(found)), [len(g) for g in found])
        at = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.owner, self.at = h[order], owner[order], at[order]
        self.seen = np.zeros(1 << _HASH_BITS, bool)
        self.seen[(self.h >> np.uint64(64 - _HASH_BITS)).astype(np.int64)] = True
        self.length = np.array([len(x) for x in self.codes], np.int64)
        self.edits = np.array([budget(len(x)) for x in self.codes], np.int64)
        self.bound = np.maximum(1, self.length - Q + 1 - Q * self.edits)

    def bands(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal) of the bands that reach their item's bound."""
        g = grams(x)
        some = np.flatnonzero(self.seen[(g >> np.uint64(64 - _HASH_BITS)).astype(np.int64)])
        low = np.searchsorted(self.h, g[some], "left")
        n = np.searchsorted(self.h, g[some], "right") - low
        held = n > 0
        some, low, n = some[held], low[held], n[held]
        if not len(n):
            return []
        hit = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        item = self.owner[hit]
        # An item with fewer hits than its bound in the whole text has no band that reaches it.
        often = (np.bincount(item, minlength=len(self.ids)) >= self.bound)[item]
        if not often.any():
            return []
        position, hit, item = np.repeat(some, n)[often], hit[often], item[often]
        width = self.edits[item] + 1
        shift = position - self.at[hit] + self.length[item]  # a diagonal, not negative
        half = shift // width
        wide = int(half.max()) + 2
        key, counts = np.unique(np.concatenate([item * wide + half, item * wide + np.maximum(half - 1, 0)]), return_counts=True)
        good = counts >= self.bound[key // wide]
        return [(int(k // wide), int((k % wide) * width_of - self.length[k // wide])) for k in key[good] for width_of in [int(self.edits[k // wide]) + 1]]

    def exact(self, x: np.ndarray) -> list[tuple[int, tuple[int, int, int]]]:
        """(item, (start, end, 0)) of the short items that stand in the text as whole words."""
        if not self.short:
            return []
        inner = np.concatenate([[False], _IN_WORD[np.minimum(x, 128)], [False]])
        edge = inner[1:] & inner[:-1]  # no word begins or ends before this character
        out = []
        for n, items in self.short.items():
            starts = np.flatnonzero(~edge[: max(len(x) - n + 1, 0)] & ~np.append(edge, False)[n : len(x) + 1])
            raw = x.tobytes()
            for s in starts.tolist():
                out += [(i, (s, s + n, 0)) for i in items.get(raw[4 * s : 4 * (s + n)], ())]
        return out

    def verified(self, x: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the item's best occurrence with diagonals in the band, if it is within budget."""
        p, e = self.codes[item], int(self.edits[item])
        low = max(0, diagonal - e)
        high = min(len(x), diagonal + len(p) + 4 * e + 2)
        found = align(p, x[low:high], e)
        return found and (low + found[0], low + found[1], found[2])


def align(p: np.ndarray, t: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of p within t with at most so many edits; ties: the first end.

    t is a band's stretch, only a few edits longer than p, so rows of the table stay within the band's width.
    """
    if len(p) == 0 or len(t) == 0:
        return None
    if len(t) >= len(p):  # without edits: no table
        for s in range(len(t) - len(p) + 1):
            if np.array_equal(p, t[s : s + len(p)]):
                return s, s + len(p), 0
    n, m = len(t), len(p)
    width = n - m + 2 * most + 1 if n >= m else 2 * most + 1
    big = m + n
    # Row i holds columns j = i - most + k for k in range(width): diagonals from -most on.
    k = np.arange(width)
    j = k - most
    cost = np.where((j >= 0) & (j <= n), 0, big)
    origin = j.copy()
    for i in range(1, m + 1):
        j = i + k - most
        inside = (j >= 0) & (j <= n)
        differs = np.ones(width, np.int64)
        real = (j >= 1) & (j <= n)
        differs[real] = t[j[real] - 1] != p[i - 1]
        step = np.where(j >= 1, cost + differs, big)
        up = np.append(cost[1:] + 1, big)
        take = up < step
        best = np.where(take, up, step)
        start = np.where(take, np.append(origin[1:], 0), origin)
        best = np.where(inside, best, big)
        # A run of insertions: the least of best[l] + (k - l) for l <= k.
        lead = best - k
        least = np.minimum.accumulate(lead)
        first = np.maximum.accumulate(np.where(lead == least, k, 0))
        start = np.where(lead > least, start[first], start)
        cost = np.where(inside, least + k, big)
        origin = start
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return (int(origin[end]), m + end - most, int(cost[end])) if cost[end] <= most else None


@lru_cache(maxsize=2)
def _index(mark: str, items: tuple[tuple[int, str], ...]) -> Index:
    """A pass's index, built once by each worker that meets it. mark: a digest of the items, which is compared first."""
    return Index(list(items))


def _find(items: tuple[tuple[int, str], ...], column: str):
    mark = hashlib.sha256(repr(items).encode()).hexdigest()

    def run(batches):
        index = _index(mark, items)
        for batch, _, _ in tx.blocks(batches, column):
            out = []
            for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
                own = []
                if text:
                    x = codes(text)
                    spans = {(index.ids[i], s) for i, d in index.bands(x) if (s := index.verified(x, i, d))}
                    own = [{"item_id": i, "start": s[0], "end": s[1], "edits": s[2]} for i, s in sorted(spans | set(index.exact(x)))]
                out.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _HITS)], [*batch.schema.names, "more"])

    return run


_HIT_TYPE = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def _passes(benchmark: DataFrame):
    """Items in passes of bounded size, streamed to the driver a partition at a time."""
    held, (item, text) = tx.positional(benchmark, "item_id", "text")
    rows = held.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).filter("item_id is not null and trim(text) <> ''")
    own, size = [], 0
    for r in rows.toLocalIterator():
        if own and size + len(r.text) > PASS_CHARS:
            yield tuple(own)
            own, size = [], 0
        own.append((r.item_id, r.text))
        size += len(r.text)
    if own:
        yield tuple(own)


def find_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "text", hits: str = "hits") -> DataFrame:
    """docs(column, ...) -> docs' columns and hits: an array of (item_id, start, end, edits) in code points of the whole
    text, end exclusive.

    An item counts where all of it stands in the text with at most budget(its length) edits, case of A-Z and kind of
    ASCII white space aside; one of fewer than Q characters where it stands as whole words without an edit. Empty or
    null items and those without an id are not searched. Null text: no hits; each row gives a row, repeated ones and
    null ids too; no rows give no rows, and an empty benchmark no hits. A very long text is searched as a whole. A
    column of docs that is named like hits is replaced; others stay, whatever their names. Each pass of PASS_CHARS
    characters of items reads the texts once.
    """
    ship(docs.sparkSession)
    held, (text,) = tx.positional(docs, column)
    out = held.withColumns({text: F.col(text).cast("string"), "hits": F.array().cast(_HIT_TYPE)})
    for items in _passes(benchmark):
        schema = T.StructType([*out.schema.fields, T.StructField("more", T.DataType.fromDDL(_HIT_TYPE))])
        out = out.mapInArrow(_find(items, text), schema).withColumn("hits", F.concat("hits", "more")).drop("more")
    kept = [i for i, n in enumerate(docs.columns) if n.lower() != hits.lower()]
    return out.select(*[f"c{i}" for i in kept], "hits").toDF(*[docs.columns[i] for i in kept], hits)


def clean(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """docs, all columns as they are and whatever their names, without the rows whose text holds a benchmark item. Null
    and empty texts stay; repeated rows stay or go together; other edges are as in find_leaks()."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    _, (text,) = tx.positional(docs, column)
    return find_leaks(docs.toDF(*names), benchmark, text, "hits").filter(F.size("hits") == 0).select(*names).toDF(*docs.columns)


def leak_report(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """docs(doc_id, column, ...) -> doc_id, contaminated, n_hits, item_ids (distinct, ascending) and hits. Edges are as in
    find_leaks(); other columns are not read."""
    found = find_leaks(tx.slim(docs, column), benchmark)
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_hits"), ids.alias("item_ids"), "hits")
