"""Byte-level BPE by corpus-level merge replay.

Texts are cut into pieces, and blocks of texts keep numbers of their distinct pieces in place of them. The distinct
pieces of all blocks are exchanged by content, so that each piece of the corpus comes to one task. There they are laid
out once, an inverted index leads from each mergeable pair to the positions where it stands, and every merge that
occurs is applied in rank order at all its positions; only the neighbours of a merged pair are looked up again. What
became of a block's pieces goes back to it, and its texts are put together from their numbers. A token is never
exchanged: a block sends each of its distinct pieces once, and its texts travel as packed numbers.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import text as tx
from loomline.session import durable_buckets, ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces and pieces of a block of texts; the last text of a block may go beyond them.
KEPT, PIECES = 150_000, 2_000_000
#: Pieces of one very long text that are cut off at once; bytes of distinct pieces that are replayed together, and rows.
AT_ONCE, REPLAYED, ROWS = 1_000_000, 2 << 20, 1 << 20
#: Buckets of pieces at most.
MOST_BUCKETS = 1 << 16


class Numbers(dict):
    """Pieces, numbered as they first come."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def cuts(find, text: str):
    """The pieces of a text, so many at once."""
    if len(text) <= AT_ONCE:
        yield find.findall(text)
        return
    found = (m[0] for m in find.finditer(text))
    while some := list(islice(found, AT_ONCE)):
        yield some


def _ragged(flat: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked rows of a ragged array one after another, and where each ends."""
    n = at[pick + 1] - at[pick]
    ends = np.cumsum(n)
    return flat[np.repeat(at[pick] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)], ends


class Codec:
    """Encoder and decoder for a file of ranks and a pattern that cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes, self.bytes_at = _laid(self.tokens)
        self.decimals, self.decimals_at = _laid([b"%d," % i for i in range(len(self.tokens))])
        self.pieces = cutter(pattern)
        self.singles = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        merges = {
            self.ranks[t[:i]] << 32 | self.ranks[t[i:]]: r
            for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        self.keys = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of neighbouring tokens' merges, or -1."""
        out = np.empty(len(a), np.int32)
        for i in range(0, len(a), AT_ONCE // 8):  # in small steps, as keys are wide
            key = a[i : i + AT_ONCE // 8].astype(np.int64) << 32 | b[i : i + AT_ONCE // 8]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[i : i + AT_ONCE // 8] = np.where(self.keys[at] == key, self.merged[at], -1)
        return out

    def one(self, piece: bytes) -> list[int]:
        """Merges of a single piece, the lowest and leftmost first; for pieces whose merges fall out of rank order."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank = lambda i, j: self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]], -1)
        heap = [(r, i, i + 1) for i in range(len(ids) - 1) if (r := rank(i, i + 1)) >= 0]
        heapify(heap)
        while heap:
            r, i, j = heappop(heap)
            if ids[i] < 0 or ids[j] < 0 or after[i] != j or rank(i, j) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (r := rank(i, k)) >= 0:
                    heappush(heap, (r, i, k))
            if (h := before[i]) >= 0 and (r := rank(h, i)) >= 0:
                heappush(heap, (r, h, i))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and len + 1 offsets."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        symbol = self.singles[raw]
        after = np.arange(1, len(raw) + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, len(raw) - 1, dtype=np.int32)
        before[starts] = -1
        live = np.ones(len(raw), bool)
        # A piece that is a token as a whole is that token, whatever its merges.
        whole = np.array([self.ranks.get(p, -1) for p in pieces])
        own = np.flatnonzero(whole >= 0)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[starts[own]] += 1
        inside[ends[own]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        live[inside] = False
        live[starts[own]] = True
        symbol[starts[own]] = whole[own]
        standing = np.full(len(raw), -1, np.int32)
        inner = np.flatnonzero((after >= 0) & ~inside).astype(np.int32)
        standing[inner] = self.pair_ranks(symbol[inner], symbol[inner + 1])
        odd = self._replay(symbol, standing, after, before, live)
        counts = np.add.reduceat(live.astype(np.int64), starts)
        ids, at = symbol[live].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])
        redo = {int(np.searchsorted(ends, x, "right")) for x in odd}
        if redo:
            parts = [np.array(self.one(pieces[k]), np.int32) if k in redo else ids[at[k] : at[k + 1]] for k in range(len(pieces))]
            ids, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, at.astype(np.int64)

    def _replay(self, symbol, standing, after, before, live) -> list[int]:
        """All merges in rank order. standing: the rank of each position's pair with the next, or -1. Returns positions
        where a merge brought forth one of lower rank."""
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(where: np.ndarray, ranks: np.ndarray) -> None:
            """Into the index, which leads from ranks to arrays of positions."""
            held = np.flatnonzero(ranks >= 0).astype(np.int32)
            held = held[np.argsort(ranks[held], kind="stable")]
            if not len(held):
                return
            where, ranks = where[held], ranks[held]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, i, j in zip(ranks[np.append(0, cut)].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(ranks)], strict=True):
                if r in index:
                    index[r].append(where[i:j])
                else:
                    index[r] = [where[i:j]]
                    heappush(heap, r)

        enter(np.arange(len(symbol), dtype=np.int32), standing)
        odd: list[int] = []
        while heap:
            r = heappop(heap)
            found = index.pop(r)
            p = found[0] if len(found) == 1 else np.concatenate(found)
            p = p[standing[p] == r]
            if not len(p):
                continue
            if len(found) > 1:
                p.sort()
                p = p[np.append(True, p[1:] != p[:-1])]
            q = after[p]
            if (symbol[p] == symbol[q]).any() and len(np.intersect1d(p, q, assume_unique=True)):
                taken, keep = set(), []
                for x, y in zip(p.tolist(), q.tolist(), strict=True):  # like x x x: the leftmost first
                    if x not in taken:
                        keep.append(x)
                        taken.add(y)
                p = np.array(keep, np.int32)
                q = after[p]
            n = after[q]
            symbol[p] = r
            standing[q] = -1
            standing[p] = -1
            live[q] = False
            after[p] = n
            some = n >= 0
            before[n[some]] = p[some]
            o = before[p]
            left = np.concatenate([p[some], o[o >= 0]])
            right = np.concatenate([n[some], p[o >= 0]])
            ranks = self.pair_ranks(symbol[left], symbol[right])
            standing[left] = ranks
            if ((ranks >= 0) & (ranks < r)).any():
                odd += left[(ranks >= 0) & (ranks < r)].tolist()
            enter(left, ranks)
        return odd

    def replay(self, pieces: list[bytes]) -> list[list[int]]:
        ids, at = self.merge(pieces)
        return [ids[i:j].tolist() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for cut in cuts(self.pieces, text):
            numbers = Numbers()
            pick = np.fromiter(map(numbers.__getitem__, cut), np.int64, len(cut))
            ids += _ragged(*self.merge([p.encode() for p in numbers]), pick)[0].tolist()
        return ids

    def decode(self, ids) -> bytes:
        return _ragged(self.bytes, self.bytes_at, np.asarray(ids, np.int64))[0].tobytes()


def _laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


@lru_cache(maxsize=2)
def cutter(pattern: str):
    import regex

    return regex.compile(pattern)


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """vocabulary: a file of ranks that each executor can open, or the name of an installed public one."""
    import public_tokenizers

    return Codec(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


#: Rows of a block: its distinct pieces by bucket (pieces), and all its texts as numbers of pieces, with each text's
#: doc_id, number of pieces and digest (texts). data is packed from so many bytes.
_PIECES = "block long, bucket int, n int, size int, data binary"
_BLOCKS = _PIECES + ", doc_ids array<long>, counts array<int>, digests array<binary>"
_NAMES = ["block", "bucket", "n", "size", "data"]
_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _packed(*arrays: np.ndarray) -> tuple[int, bytes]:
    """Arrays' bytes, those of a plane together: the high ones of small numbers are all alike."""
    data = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in arrays)
    return len(data), pa.compress(data, "zstd", asbytes=True)


def _unpacked(size: int, data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """The first n numbers and the bytes after them."""
    raw = pa.decompress(data, size, "zstd", asbytes=True) if size else b""
    return _numbers(raw[: 4 * n]), raw[4 * n :]


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = dict(zip([*_NAMES, "doc_ids", "counts", "digests"], _TYPES, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[n]) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)


def _block_rows(block: int, numbers: Numbers, texts: list[tuple], buckets: int):
    """Pieces by bucket, the most frequent first in each; numbers in texts are ranks by frequency."""
    picks = np.concatenate([pick for _, pick, _ in texts])
    often = np.argsort(-np.bincount(picks, minlength=len(numbers)), kind="stable")
    rank = np.empty(len(often), np.int32)
    rank[often] = np.arange(len(often), dtype=np.int32)
    raw, at = _laid([p.encode() for p in numbers])
    bucket = (tx.content_hash(raw, at[:-1], at[1:]) % np.uint64(buckets)).astype(np.int32)[often]
    order = np.argsort(bucket, kind="stable")
    flat, ends = _ragged(raw, at, often[order])
    sizes = np.diff(ends, prepend=0).astype(np.int32)
    own, first = np.unique(bucket[order], return_index=True)
    for b, i, j in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(order)][: len(own)], strict=True):
        yield (block, b, j - i, *_packed(sizes[i:j], flat[ends[i] - sizes[i] : ends[j - 1]]), None, None, None)
    doc_ids, counts, digests = zip(*[(d, len(pick), digest) for d, pick, digest in texts], strict=True)
    yield (block, None, len(bucket), *_packed(bucket, rank[picks]), doc_ids, counts, digests)


def _cut_blocks(buckets: int):
    def run(batches):
        import public_tokenizers

        find = cutter(public_tokenizers.PATTERN)
        block = TaskContext.get().partitionId() << 32
        numbers, texts, size = Numbers(), [], 0
        names = [*_NAMES, "doc_ids", "counts", "digests"]
        for batch, _, _ in tx.blocks(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                pick = np.concatenate([np.fromiter(map(numbers.__getitem__, cut), np.int32, len(cut)) for cut in cuts(find, text)])
                texts.append((doc_id, pick, _digest(text.encode())))
                size += len(pick)
                if len(numbers) >= KEPT or size >= PIECES:
                    yield _batch(list(_block_rows(block, numbers, texts, buckets)), names)
                    numbers, texts, size = Numbers(), [], 0
                    block += 1
        if texts:
            yield _batch(list(_block_rows(block, numbers, texts, buckets)), names)
        tx.trim()

    return run


def _replay_task(vocabulary: str):
    """Blocks' rows of pieces in order of bucket, so that equal pieces come near each other -> the same rows with the
    pieces' ids. What is distinct of REPLAYED bytes of pieces, or little more, is replayed together."""

    def run(batches):
        c = codec(vocabulary)
        held, numbers, size, rows = [], Numbers(), 0, 0

        def made():
            ids, at = c.merge(list(numbers))
            out = []
            for block, bucket, own in held:
                flat, ends = _ragged(ids, at, own)
                out.append((block, bucket, len(own), *_packed(np.diff(ends, prepend=0).astype(np.int32), flat)))
            return _batch(out, _NAMES)

        for batch in batches:
            for block, bucket, n, length, data in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                sizes, raw = _unpacked(length, data, n)
                ends = np.cumsum(sizes).tolist()
                known = len(numbers)
                pieces = [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
                held.append((block, bucket, np.fromiter(map(numbers.__getitem__, pieces), np.int64, n)))
                rows += n
                size += len(raw) * (len(numbers) - known) // n
                if size >= REPLAYED or rows >= ROWS:
                    yield made()
                    held, numbers, size, rows = [], Numbers(), 0, 0
        if held:
            yield made()
        tx.trim()

    return run


def _assembled(texts: pa.Table, pieces: pa.Table):
    """A block's row of texts and its rows of pieces -> (doc_id, ids, digest of the text) of each text."""
    parts = sorted(zip(*[pieces.column(k).to_pylist() for k in ("bucket", "n", "size", "data")], strict=True))
    sizes, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for _, n, size, data in parts:
        own, rest = _unpacked(size, data, n)
        sizes.append(own)
        flat.append(_numbers(rest))
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    ids = np.concatenate(flat)
    n, size, data, doc_ids, counts, digests = (texts.column(k)[0].as_py() for k in ("n", "size", "data", "doc_ids", "counts", "digests"))
    bucket, rest = _unpacked(size, data, n)
    place = np.empty(n, np.int64)
    place[np.argsort(bucket, kind="stable")] = np.arange(n)
    picks = _numbers(rest)
    for doc_id, end, count, digest in zip(doc_ids, np.cumsum(counts).tolist(), counts, digests, strict=True):
        yield doc_id, _ragged(ids, at, place[picks[end - count : end]])[0], digest


def _digests(vocabulary: str):
    def run(texts: pa.Table, pieces: pa.Table) -> pa.Table:
        c = codec(vocabulary)
        found = []
        for doc_id, ids, _ in _assembled(texts, pieces):
            decimal = _ragged(c.decimals, c.decimals_at, ids)[0][:-1]
            found.append((doc_id, len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _id_rows(vocabulary: str):
    def run(texts: pa.Table, pieces: pa.Table) -> pa.Table:
        c = codec(vocabulary)
        doc_ids, parts, back = [], [], []
        for doc_id, ids, digest in _assembled(texts, pieces):
            doc_ids.append(doc_id)
            parts.append(ids)
            back.append(_digest(c.decode(ids)) == digest)
        n = np.array([len(x) for x in parts], np.int64)
        lists = tx.lists(np.concatenate(parts), np.concatenate([[0], np.cumsum(n)]), pa.int32())
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(n), lists, pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return run


def _texts(ids: str, vocabulary: str):
    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            texts = [c.decode(x or []).decode(errors="replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _buckets(docs: DataFrame) -> int:
    """One for each MB that the optimiser expects; more than MOST_BUCKETS would leave single pieces in a row."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(size >> 20, 64), MOST_BUCKETS)


def _encoded(docs: DataFrame, column: str, vocabulary: str, finish, schema: str) -> DataFrame:
    """finish() of each block, whose texts stay where they are: only pieces are exchanged, to their buckets and back."""
    ship(docs.sparkSession)
    blocks = durable_buckets(tx.slim(docs, column).mapInArrow(_cut_blocks(_buckets(docs)), _BLOCKS), "block", "blocks")
    pieces = blocks.filter("bucket is not null").select(*_NAMES).repartition("bucket").sortWithinPartitions("bucket", "block")
    replayed = pieces.mapInArrow(_replay_task(vocabulary), _PIECES)
    texts = blocks.filter("bucket is null").drop("bucket")
    return texts.groupBy("block").cogroup(replayed.groupBy("block")).applyInArrow(finish(vocabulary), schema)


def encode(docs: DataFrame, column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, column, ...) -> doc_id, n_tokens, ids (array of int), round_trip (the ids decode to the text).

    Ids are those of a rank-merging byte-level encoder that treats each match of the vocabulary's pattern separately
    and knows no special tokens. Null and empty texts have no ids; each row gives a row, repeated rows and null doc_ids
    too; a very long text is held whole, as its distinct pieces and numbers. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    return _encoded(docs, column, vocabulary, _id_rows, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows(doc_id, ids, ...) -> doc_id, text. Null ids: empty text; ids whose bytes are no whole UTF-8: replacement marks."""
    ship(rows.sparkSession)
    slim = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return slim.mapInArrow(_texts("ids", vocabulary), "doc_id long, text string")


def digests(docs: DataFrame, column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """As encode(), with SHA-256 digests of the decimal ids joined by commas and of the decoded bytes."""
    return _encoded(docs, column, vocabulary, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
