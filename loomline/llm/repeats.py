"""Repeated byte strings by a logarithmic family of sparse suffix arrays.

A suffix array over every byte would be many times the text, so the arrays hold anchors: in each string of LENGTH bytes
the GRAM-byte string with the least hash is the anchor, and strings with equal bytes have equal anchors. Neighbouring
strings with one anchor form a run. An entry is a run, and its suffix is the one that begins at its anchor: arrays are
in order of the suffixes' first GRAM bytes, as they are, and then of a hash of all of the run's bytes. An array is cut
into buckets by anchor, which tasks work on by themselves.

Documents come in batches in order of doc_id. A batch's array is merge-scanned with all levels of the index:

* an entry equal to an earlier one is a repeat as a whole;
* an entry that shares only its anchor with another may repeat in part, and both are marked. Marked runs, a small part
  of all, are read again and compared string by string;
* what is new becomes a level, and levels of equal size merge, as digits carry in a binary counter.

Levels keep only the first of equal entries. Equal entries within a block of texts meet before they are exchanged, so
copies and common passages weigh little. Of an anchor that many different runs of a block share, all are marked at once,
and one goes on as a witness that marks whatever else has the anchor; a bucket that grows beyond bounds does the same
with its most frequent anchors. So no anchor's entries are gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import text as tx
from loomline.session import discard, durable, durable_parts, release, ship

LENGTH, GRAM = 100, 24
#: Bytes of text that are scanned together; longer texts are scanned in overlapping pieces.
BLOCK = 2 << 20
BATCHES = 8
#: Marked runs of an anchor that are compared together; those of an anchor with more are compared string by string.
FEW = 2048
#: So many anchors with more runs, a few MB, go to all executors; more of them are joined by an exchange.
FEW_ANCHORS = 200_000
#: Different runs of an anchor in a block, or in a bucket that is too large, from which on all are marked.
HOT = 32
#: Entries of a bucket that are merged at once, and that it may hold.
CHUNK, MOST = 1 << 20, 4 << 20
#: Bytes of texts for each bucket, as the optimiser expects them, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 1 << 20
_AT = np.uint64((1 << 24) - 1)
_NEW, _REPEAT, _MARKED = 0, 1, 2
#: Where a row of entries comes from; known repeats and marked runs pass through.
_FRESH, _STAYING, _KNOWN, _HOT = 0, 1, 2, 3


def _minima(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many neighbours, by doubling."""
    least, span = key, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (width - span)], least[width - span :]) if span < width else least


def runs(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, key) of the runs of all strings of so many bytes. A key is the anchor's bytes and
    eight of a hash of the run's bytes and the anchor's place in it, as a row of bytes."""
    n = len(raw)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros((0, gram + 8), np.uint8)
    c = tx.prefix(raw)
    start = np.arange(n - gram + 1)
    hashed = tx.spans_hash(c, start, start + gram)
    anchor = (_minima((hashed & ~_AT) | start.astype(np.uint64), length - gram + 1) & _AT).astype(np.int64)
    whole = np.zeros(n + 1, np.int64)
    ends = at[1:][np.diff(at) >= length]
    begins = at[:-1][np.diff(at) >= length]
    whole[begins] += 1
    np.add.at(whole, ends - length + 1, -1)
    whole = np.cumsum(whole)[: len(anchor)] > 0
    change = np.ones(len(anchor) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change[:-1] & whole)
    last = np.flatnonzero(change[1:] & whole)
    # Two texts of exactly `length` bytes meet without a gap only where a text ends; anchors in both can't be the same.
    place = anchor[first]
    run = tx.mix(tx.spans_hash(c, first, last + length) + (place - first).astype(np.uint64) * tx.PLACES[0] + (last - first).astype(np.uint64) * tx.PLACES[1])
    key = np.empty((len(first), gram + 8), np.uint8)
    key[:, :gram] = np.lib.stride_tricks.sliding_window_view(raw, gram)[place]
    key[:, gram:] = run.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.searchsorted(at, first, "right") - 1, first, last, key


def _pieces(batches, length: int, column: str = "text"):
    """(ids, offsets of the pieces in their texts, bytes, piece ends) of blocks; long texts in overlapping pieces."""
    for batch, raw, at in tx.blocks(batches, column, BLOCK):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        if len(raw) <= 2 * BLOCK:
            yield ids, np.zeros(len(ids), np.int64), raw, at
            continue
        for i in range(len(ids)):
            for s in range(int(at[i]), max(int(at[i + 1]) - length + 1, int(at[i]) + 1), BLOCK):
                part = raw[s : min(s + BLOCK + length - 1, at[i + 1])]
                yield ids[i : i + 1], np.array([s - at[i]], np.int64), part, np.array([0, len(part)], np.int64)


def _firsts(keys: tuple[np.ndarray, ...], ids: np.ndarray, start: np.ndarray, same_bytes=None) -> np.ndarray:
    """Which entries are the first of their key, by id and start."""
    order = np.lexsort((start, ids, *keys))
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    if same_bytes and same.any():
        at = np.flatnonzero(same)
        same[at] = same_bytes(order[at], order[at + 1])
    out = np.ones(len(order), bool)
    out[order[1:][same]] = False
    return out


def _joined(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring ranges of starts of one document as one; ranges must come in their documents' order."""
    if not len(ids):
        return ids, first, last
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (first[1:] != last[:-1] + 1)
    at = np.flatnonzero(new)
    return ids[at], first[at], last[np.append(at[1:], len(ids)) - 1]


def _place(first: np.ndarray, last: np.ndarray, state: np.ndarray | int) -> np.ndarray:
    """First, last and state in one number that orders as first does."""
    return first.astype(np.int64) << 32 | (last - first).astype(np.int64) << 2 | state


def _range(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = place >> 32
    return first, first + ((place & 0xFFFFFFFF) >> 2)


def _order(key: np.ndarray) -> np.ndarray:
    """Of rows of bytes, stable."""
    return np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").reshape(-1), kind="stable")


def _new(rows: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    out = np.ones(len(rows), bool)
    out[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return out


def _sizes(new: np.ndarray) -> np.ndarray:
    """For each row the size of its group, where new tells which rows begin one."""
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(new)))
    return np.repeat(n, n)


def _anchors(key: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each key's anchor."""
    out = np.zeros(len(key), np.uint64)
    for k in range(gram):
        out = out * np.uint64(tx.BASE) + key[:, k]
    return tx.mix(out + np.uint64(1))


#: Entries and ranges as they are exchanged and held: n of them, packed from so many bytes.
_ROWS = "bucket int, source int, n int, size int, data binary"
_PARTS = "kind string, bucket int, n int, size int, data binary"


def _packed(*arrays: np.ndarray) -> tuple[int, int, bytes]:
    """(n, bytes, packed) of arrays of n rows; bytes of a place in the rows stand together."""
    data = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in arrays)
    return len(arrays[0]), len(data), pa.compress(data, "zstd", asbytes=True)


def _unpacked(n: int, size: int, data: bytes, *widths: int) -> list[np.ndarray]:
    """The arrays: of numbers for a width of 0, else of rows of so many bytes."""
    raw, at, out = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint8), 0, []
    for w in widths:
        rows = np.ascontiguousarray(raw[at : at + n * (w or 8)].reshape(-1, n).T)
        out.append(rows if w else rows.view(np.int64).reshape(-1))
        at += n * (w or 8)
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])


def _entries(length: int, gram: int, buckets: int):
    """The array of each block of texts, by buckets."""

    def run_task(batches):
        for ids, offset, raw, at in _pieces(batches, length):
            text, first, last, key = runs(raw, at, length, gram)
            own = ids[text]
            place = _place(first - at[text] + offset[text], last - at[text] + offset[text], _NEW)
            order = np.lexsort((place, own))
            order = order[_order(key[order])]
            key, own, place = key[order], own[order], place[order]
            held = _new(key)
            rows = []
            if not held.all():
                again = np.lexsort((place[~held], own[~held]))
                known = _joined(own[~held][again], *_range(place[~held][again]))
                rows.append((int(ids[0]) % buckets, _KNOWN, *_packed(known[0], _place(known[1], known[2], _REPEAT))))
            key, own, place = key[held], own[held], place[held]
            first_of = _new(key[:, :gram])
            hot = _sizes(first_of) >= HOT
            anchor = _anchors(key, gram)
            if hot.any():
                rows.append((int(ids[0]) % buckets, _HOT, *_packed(own[hot], place[hot], anchor[hot].view(np.int64))))
                place = np.where(hot, place | _MARKED, place)
                stay = ~hot | first_of
                key, own, place, anchor = key[stay], own[stay], place[stay], anchor[stay]
            bucket = (anchor % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.flatnonzero(np.append(bucket[order][1:] != bucket[order][:-1], True)) + 1 if len(order) else []
            begin = 0
            for end in ends:
                some = order[begin:end]
                rows.append((int(bucket[some[0]]), _FRESH, *_packed(key[some], own[some], place[some])))
                begin = end
            yield _batch(rows, _ROWS)

    return run_task


class _Bucket:
    """A bucket's entries as rows of it come in: of equal ones the first by id and place stays."""

    def __init__(self, number: int, gram: int):
        self.number, self.gram = number, gram
        self.key, self.id, self.place, self.fresh = np.zeros((0, gram + 8), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.waiting: list[tuple] = []
        self.size = 0
        self.repeats: list[tuple] = []
        self.marked: list[tuple] = []

    def add(self, source: int, n: int, size: int, data: bytes) -> None:
        self.waiting.append((*_unpacked(n, size, data, self.gram + 8, 0, 0), np.full(n, source == _FRESH)))
        self.size += n
        if self.size >= CHUNK:
            self.merge()

    def merge(self) -> None:
        parts = [(self.key, self.id, self.place, self.fresh), *self.waiting]
        self.waiting, self.size = [], 0
        key, own, place, fresh = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, own))
        order = order[_order(key[order])]
        key, own, place, fresh = key[order], own[order], place[order], fresh[order]
        held = _new(key)
        if not held.all():
            self.repeats.append((own[~held], place[~held]))
        self.key, self.id, self.place, self.fresh = key[held], own[held], place[held], fresh[held]
        if len(self.key) > MOST:
            first_of = _new(self.key[:, : self.gram])
            hot = _sizes(first_of) >= HOT
            self._mark(hot)
            self._keep(~hot | first_of)

    def _mark(self, some: np.ndarray) -> None:
        some = some & (self.place & 3 != _MARKED)
        if some.any():
            self.marked.append((self.id[some], self.place[some], _anchors(self.key[some], self.gram).view(np.int64)))
            self.place = np.where(some, self.place | _MARKED, self.place)

    def _keep(self, some: np.ndarray) -> None:
        self.key, self.id, self.place, self.fresh = self.key[some], self.id[some], self.place[some], self.fresh[some]

    def done(self):
        """Rows of what was found and of the new level."""
        if self.waiting:
            self.merge()
        self._mark(_sizes(_new(self.key[:, : self.gram])) > 1)
        for kind, parts in (("repeat", self.repeats), ("marked", self.marked)):
            if parts:
                yield (kind, self.number, *_packed(*(np.concatenate(x) for x in zip(*parts, strict=True))))
        self._keep(self.fresh)
        if len(self.key):
            yield ("level", self.number, *_packed(self.key, self.id, self.place))


def _merge_scan(gram: int):
    """Rows of entries in order of bucket and source -> repeats, marked runs and the new level of each bucket."""

    def run_task(batches):
        bucket = None
        for batch in batches:
            out = []
            for number, source, n, size, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if source in (_KNOWN, _HOT):
                    out.append(("repeat" if source == _KNOWN else "marked", number, n, size, data))
                    continue
                if bucket is None or bucket.number != number:
                    out += bucket.done() if bucket else ()
                    bucket = _Bucket(number, gram)
                bucket.add(source, n, size, data)
            yield _batch(out, _PARTS)
        if bucket:
            yield _batch(list(bucket.done()), _PARTS)
        tx.trim()

    return run_task


def _open_ranges(batches):
    """Packed repeats, or marked runs with a hash of their anchor, as rows."""
    for batch in batches:
        for n, size, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own, place, *anchor = _unpacked(n, size, data, *[0] * (size // (8 * n)))
            first, last = (x.astype(np.int32) for x in _range(place))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, first, last, *anchor)], ["id", "first", "last", "anchor"][: 3 + len(anchor)])


class Index:
    """The family of levels. add() takes a batch of documents whose ids are above all earlier ones."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, buckets: int = 64):
        self.length, self.gram, self.buckets = length, gram, buckets
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, entries), the largest first
        self.merges = 0
        self._repeats: list[DataFrame] = []
        self._marked: list[DataFrame] = []

    def add(self, docs: DataFrame) -> None:
        """docs(id, text)."""
        release(docs.sparkSession)
        size, merging = 1, []
        while len(merging) < len(self.levels) and self.levels[-1 - len(merging)][0] == size:
            merging.append(self.levels[-1 - len(merging)][1])
            size *= 2
        staying = self.levels[: len(self.levels) - len(merging)]
        rows = docs.select("id", "text").mapInArrow(_entries(self.length, self.gram, self.buckets), _ROWS)
        for source, level in [*((_FRESH, x) for x in merging), *((_STAYING, x) for _, x in staying)]:
            rows = rows.unionByName(level.select("bucket", F.lit(source).alias("source"), "n", "size", "data"))
        order = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("source").desc())
        found = durable_parts(order.mapInArrow(_merge_scan(self.gram), _PARTS), "kind", ["level", "repeat", "marked"], "level")
        discard(*merging)
        self.merges += len(merging)
        self.levels = [*staying, (size, found[0])]
        self._repeats.append(found[1])
        self._marked.append(found[2])

    def repeats(self) -> DataFrame:
        """(id, first, last): ranges of starts whose strings also start earlier."""
        return _union(self._repeats).select("n", "size", "data").mapInArrow(_open_ranges, "id long, first int, last int")

    def marked(self) -> DataFrame:
        """(id, first, last, anchor): runs that share their anchor with others, once each."""
        return _union(self._marked).select("n", "size", "data").mapInArrow(_open_ranges, "id long, first int, last int, anchor long").distinct()

    def discard(self) -> None:
        discard(*[level for _, level in self.levels], *self._repeats, *self._marked)
        self.levels, self._repeats, self._marked = [], [], []


def _zipped(batches):
    for batch in batches:
        data = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0),
            pa.array([pa.compress((t or "").encode(), "zstd", asbytes=True) for t in data], pa.binary()),
            pa.array([len((t or "").encode()) for t in data], pa.int64())], ["id", "zipped", "n_bytes"])


def _zip(docs: DataFrame) -> DataFrame:
    """Texts as they are exchanged: compressed."""
    return docs.select("id", "text").mapInArrow(_zipped, "id long, zipped binary, n_bytes long")


def _unzipped(row) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["zipped"], row["n_bytes"], "zstd", asbytes=True), np.uint8) if row["n_bytes"] else np.zeros(0, np.uint8)


#: A string or a run as it is compared: place holds first, last and state in one number that orders as first does.
_ENTRY = "anchor long, run long, id long, place long"


def _entry_batch(anchor, run, ids, first, last, state) -> pa.RecordBatch:
    place = _place(first, last, state.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(ids), pa.array(place)], ["anchor", "run", "id", "place"])


def _entry_arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    x = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("anchor", "run", "id", "place")}
    place = x.pop("place")
    first, last = _range(place)
    return x | {"first": first, "last": last, "state": place & 3}


def _first_strings(ids, start, hashed, anchor, same=None) -> tuple[np.ndarray, ...]:
    """Of strings, those that are the first of equal ones, and the others' places as joined ranges. same: tells of pairs
    of strings with equal hashes whether their bytes are equal."""
    held = _firsts((hashed, anchor), ids, start, same)
    order = np.lexsort((start[~held], ids[~held]))
    return held, _joined(ids[~held][order], start[~held][order], start[~held][order])


_STRING = "deal long, " + _ENTRY + ", content binary"


def _string_batch(entry: pa.RecordBatch, deal: np.ndarray, content) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), *entry.columns, pa.array(content, pa.binary())], ["deal", *entry.schema.names, "content"])


def _strings(length: int):
    """Marked runs as they are compared: those of an anchor with few runs as their content, dealt by anchor; those of
    others string by string, dealt by the string's hash. Of equal strings in a batch only the first goes on."""

    def block(parts):
        ids, start, hashed, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        held, again = _first_strings(ids, start, hashed, anchor)
        spread = tx.mix(again[0].astype(np.uint64) * tx.PLACES[3] + again[1].astype(np.uint64))
        cat = np.concatenate
        entry = _entry_batch(cat([anchor[held], spread]), cat([hashed[held], spread]), cat([ids[held], again[0]]), cat([start[held], again[1]]),
            cat([start[held], again[2]]), np.repeat([_NEW, _REPEAT], [held.sum(), len(spread)]))
        return _string_batch(entry, cat([hashed[held], spread]), [None] * entry.num_rows)

    def run_task(batches):
        parts, size = [], 0
        for batch in batches:
            few: list[tuple] = []
            for row in batch.to_pylist():
                raw = _unzipped(row)
                marks = sorted((r["first"], r["last"], r["anchor"]) for r in row["marks"] if r["few"])
                few += [(a, row["id"], f, z, raw[f : z + length].tobytes()) for f, z, a in marks]
                many = sorted((r["first"], r["last"], r["anchor"]) for r in row["marks"] if not r["few"])
                if many:
                    first, last, anchor = (np.array(x, np.int64) for x in zip(*many, strict=True))
                    n = last - first + 1
                    start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                    parts.append((np.full(len(start), row["id"], np.int64), start, tx.spans_hash(tx.prefix(raw), start, start + length),
                        np.repeat(anchor.view(np.uint64), n)))
                    size += len(start)
                if size >= 1 << 19:
                    yield block(parts)
                    parts, size = [], 0
            if few:
                anchor, ids, first, last = (np.array(x, np.int64) for x in list(zip(*few, strict=True))[:4])
                anchor = anchor.view(np.uint64)
                yield _string_batch(_entry_batch(anchor, np.zeros(len(few), np.uint64), ids, first, last, np.full(len(few), _MARKED)), anchor, [x[4] for x in few])
        if parts:
            yield block(parts)

    return run_task


def _repeated_strings(length: int):
    """Rows of _strings() in order of (deal, anchor, run, id, place) -> places of all but the first of equal strings, and
    of known repeats. Runs of an anchor, FEW at most, are compared together; of single strings one is held at a time."""

    def together(parts):
        anchor, ids, first, last = (np.concatenate([p[i] for p in parts]) for i in range(4))
        raw, at = tx.bytes_of(pa.concat_arrays([p[4] for p in parts]))
        n = last - first + 1
        within = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        begin = np.repeat(at[:-1], n) + within
        hashed = tx.spans_hash(tx.prefix(raw), begin, begin + length)
        strings = np.lib.stride_tricks.sliding_window_view(raw, length)

        def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.concatenate([(strings[begin[a[i : i + 4096]]] == strings[begin[b[i : i + 4096]]]).all(axis=1) for i in range(0, len(a), 4096)])

        return _first_strings(np.repeat(ids, n), np.repeat(first, n) + within, hashed, np.repeat(anchor, n), same)[1]

    def ranges(ids, first, last):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["id", "first", "last"])

    def run_task(batches):
        before, parts, size = None, [], 0
        for batch in batches:
            if not len(batch):
                continue
            e = _entry_arrays(batch)
            known = e["state"] == _REPEAT
            alone = e["state"] != _MARKED
            again = np.zeros(len(known), bool)
            again[1:] = (e["anchor"][1:] == e["anchor"][:-1]) & (e["run"][1:] == e["run"][:-1]) & ~known[1:] & ~known[:-1] & alone[1:] & alone[:-1]
            again[0] = before is not None and alone[0] and not known[0] and before == (e["anchor"][0], e["run"][0])
            before = (e["anchor"][-1], e["run"][-1]) if alone[-1] and not known[-1] else None
            out = again | known
            if out.any():
                yield ranges(e["id"][out], e["first"][out], e["last"][out])
            some = np.flatnonzero(~alone)
            if len(some):
                content = batch.column(batch.schema.get_field_index("content")).take(pa.array(some))
                anchor = e["anchor"][some]
                # Anchors that end in this batch are whole; the last one may go on.
                edge = int(np.searchsorted(np.cumsum(np.append(False, anchor[1:] != anchor[:-1])), np.count_nonzero(anchor[1:] != anchor[:-1]), "left"))
                new = [anchor, e["id"][some], e["first"][some], e["last"][some], content]
                if parts and parts[-1][0][-1] == anchor[0] and edge == 0:
                    parts.append(new)
                else:
                    parts.append([x[:edge] for x in new])
                    rest = [x[edge:] for x in new]
                    size += edge
                    if size >= 4096:
                        yield ranges(*together([p for p in parts if len(p[0])]))
                        parts, size = [], 0
                    parts.append(rest)
        parts = [p for p in parts if len(p[0])]
        if parts:
            yield ranges(*together(parts))

    return run_task


def _cut(length: int, whole: bool):
    def run_task(batches):
        for batch in batches:
            n, removed, spans, digests, texts = [], [], [], [], []
            for row in batch.to_pylist():
                raw = _unzipped(row)
                edge = np.zeros(len(raw) + 1, np.int64)
                for r in row["ranges"] or ():
                    edge[r["first"]] += 1
                    edge[min(r["last"] + length, len(raw))] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                left = raw[~gone].tobytes()
                n.append(len(raw))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left if whole else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array(digests, pa.string()),
                    pa.array(texts, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run_task


def _numbered(docs: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """(id, text) with an id of their own for different texts of one doc_id and for null doc_ids."""
    rows = tx.slim(docs, column)
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if counted.n == counted.ids:
        return rows.select("doc_id", F.col("doc_id").alias("id"), "text"), True
    keyed = rows.withColumn("sum", F.xxhash64("text"))
    ids = durable(keyed.select("doc_id", "sum").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "sum").withColumn("id", F.monotonically_increasing_id()), "ids")
    ids = ids.withColumnsRenamed({"doc_id": "d", "sum": "s"})
    return keyed.join(ids, keyed.doc_id.eqNullSafe(ids.d) & (keyed["sum"] == ids.s)).select("doc_id", "id", "text"), False


def remove_repeats(docs: DataFrame, column: str = "text", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, whole: bool = False) -> DataFrame:
    """docs(doc_id, column, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with whole, kept (the bytes).

    Every byte goes that is covered by a string of `length` bytes which also starts earlier, in a smaller doc_id or
    earlier in the same document. Strings are judged on the texts as they came and never cross documents. Null text:
    empty; a text has less than a GiB. Equal rows (doc_id and text) are one document and give equal rows; different texts of one doc_id are
    documents in the order of a hash of the text; null doc_ids come first. Other columns are not read.
    """
    ship(docs.sparkSession)
    rows, alone = _numbered(docs, column)
    texts = rows.select("id", "text") if alone else rows.select("id", "text").dropDuplicates(["id"])
    cuts = texts.stat.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    cuts = [None, *sorted({int(x) for x in cuts or []}), None]
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    index = Index(length, gram, min(max(size // BUCKET_BYTES, 64), MOST_BUCKETS))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = texts if low is None else texts.filter(F.col("id") > low)
        index.add(part if high is None else part.filter(F.col("id") <= high))
    ranges = index.repeats()
    marked = durable(index.marked(), "marked")
    many = durable(marked.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select("anchor", F.lit(False).alias("few")), "many")
    many = F.broadcast(many) if many.count() <= FEW_ANCHORS else many
    marks = marked.join(many, "anchor", "left").withColumn("few", F.col("few").isNull()).groupBy("id").agg(F.collect_list(F.struct("first", "last", "anchor", "few")).alias("marks"))
    strings = _zip(texts).join(marks, "id").mapInArrow(_strings(length), _STRING)
    partly = strings.repartition("deal").sortWithinPartitions("deal", "anchor", "run", "id", "place").mapInArrow(_repeated_strings(length),
        "id long, first int, last int")
    partly = durable(partly, "partly")
    release(docs.sparkSession)
    ranges = durable(ranges.unionByName(partly).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    discard(partly, marked)
    index.discard()
    done = _zip(texts).join(ranges, "id", "left").mapInArrow(_cut(length, whole), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if not alone:
        done = rows.select("doc_id", "id").join(durable(done, "cut"), "id")
    return done.select(*([F.col("id").alias("doc_id")] if alone else ["doc_id"]), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if whole else []))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
