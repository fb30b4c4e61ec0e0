"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit universe make every signature coordinate: the first shuffles a shingle's number, the
second is applied after a circular shift by the coordinate's number. Bands of coordinates are bucket keys. Links are
confirmed on the full shingle sets.

No group is gathered, and no pairs of a group's copies are made. Every bucket first compares its members with its
smallest one, and connected components follow. Only a bucket whose members are then still in different components goes
on: the members outside its largest component (strays) are compared with all others, in blocks of bounded size that
yield only links. Texts whose sets are too different in size to be similar never share a block. So no candidate pair
stays unsettled: it was compared, or can't be similar, or its texts are linked through others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import text as tx
from loomline.operators.components import components
from loomline.session import discard, durable, packed, ship

BANDS, ROWS = 32, 4
#: Texts of a block in which strays are compared, and the salts over which a pivot's members are dealt.
BLOCK = 256
PIVOT_SALTS = 16
#: Rows of a partition of entries (bucket, text), and texts of one, where a table has few.
ENTRIES, TEXTS = 1 << 16, 1 << 10
U32 = np.uint32


def _first(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U32(16))
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def signatures(sets: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """(coordinates, texts) array of minima. Coordinate k is the least of second(first(x) - k mod 2**32)."""
    base = _first(sets.astype(U32))
    out = np.zeros((coordinates, len(at) - 1), U32)
    x, y = np.empty_like(base), np.empty_like(base)
    for k in range(coordinates):
        np.subtract(base, U32(k), out=x)
        np.right_shift(x, U32(16), out=y)
        x ^= y
        x *= U32(0x21F0AAAD)
        np.right_shift(x, U32(15), out=y)
        x ^= y
        x *= U32(0x735A2D97)
        np.right_shift(x, U32(15), out=y)
        x ^= y
        out[k] = tx.reduce_at(np.minimum, x, at, 0)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(bands, texts) bucket keys."""
    bands = signature.shape[0] // rows
    out = np.empty((bands, signature.shape[1]), np.uint64)
    for b in range(bands):
        h = np.full(signature.shape[1], b + 1, np.uint64)
        for r in range(rows):
            h = tx.mix(h * tx.PLACES[0] + signature[b * rows + r])
        out[b] = h
    return out


def _sketches(column: str, bands: int, rows: int, size: int):
    def run(batches):
        for batch, raw, at in tx.blocks(batches, column):
            sets, sat = tx.distinct(*tx.shingles(*tx.word_hashes(raw, at), size))
            keys = band_keys(signatures(sets, sat, bands * rows), rows)
            n = np.diff(sat)
            held = n > 0
            kat = np.concatenate([[0], np.cumsum(np.where(held, bands, 0))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(tx.reduce_at(np.add, tx.mix(sets ^ tx.PLACES[1]), sat, 0).view(np.int64)),
                    pa.array(tx.reduce_at(np.add, tx.mix(sets ^ tx.PLACES[2]), sat, 0).view(np.int64)),
                    tx.lists(keys.T[held].reshape(-1).view(np.int64), kat, pa.int64()),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return run


def _verify(size: int, threshold: int):
    """Rows of a group (pivot, salt) come together, the pivot's own first; yields the pairs that hold."""

    def run(batches):
        key, own = None, None
        for batch, raw, at in tx.blocks(batches, "text"):
            sets, sat = tx.distinct(*tx.shingles(*tx.word_hashes(raw, at), size))
            us, vs = [], []
            pivots, salts, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for i in range(len(batch)):
                mine = sets[sat[i] : sat[i + 1]]
                if key != (pivots[i], salts[i]):
                    key, own = (pivots[i], salts[i]), {}
                if ids[i] == pivots[i]:
                    own[len(own)] = mine
                    continue
                for other in own.values():
                    both = len(np.intersect1d(other, mine, assume_unique=True)) if min(len(other), len(mine)) * 100 >= threshold * max(len(other), len(mine)) else 0
                    if both and both * 100 >= threshold * (len(other) + len(mine) - both):
                        us.append(pivots[i])
                        vs.append(ids[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """pairs(u, v) of documents -> those whose sets are similar enough. A pivot's text goes once to each of a few
    salts, not to each of its pairs."""
    pairs = pairs.select("u", "v", F.pmod(F.hash("v"), F.lit(PIVOT_SALTS)).alias("salt"))
    members = pairs.select(F.col("u").alias("pivot"), "salt", F.col("v").alias("doc_id"))
    pivots = pairs.select(F.col("u").alias("pivot"), "salt", F.col("u").alias("doc_id")).distinct()
    rows = members.unionByName(pivots).join(texts, "doc_id").select("pivot", "salt", "doc_id", "text")
    dealt = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("doc_id") != F.col("pivot"))
    return dealt.mapInArrow(_verify(size, threshold), "u long, v long")


def _pivot_pairs(live: DataFrame) -> DataFrame:
    """(b, rep, n) -> each member with its bucket's smallest."""
    low = live.groupBy("b").agg(F.min("rep").alias("u"))
    return live.join(low, "b").filter("rep <> u").select("u", F.col("rep").alias("v")).distinct()


def _strays(live: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """(anchor, rep, comp, stray, size) of buckets whose members are in more than one component; the anchor is the component
    with most of a bucket's members. Buckets of two were settled by the comparison with their smallest member. Sets of
    similar texts have the same or neighbouring sizes, which are classes of so many shingles."""
    held = live.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("comp")), "rep", "left").select("b", "rep", "n",
        F.coalesce("comp", "rep").alias("comp"))
    mixed = held.groupBy("b", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("b").agg(
        F.max_by("comp", F.struct("k", -F.col("comp"))).alias("anchor"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("comps"))
    mixed = mixed.filter("m > 2 and comps > 1").select("b", "anchor")
    step = math.log(100 / threshold) if threshold < 100 else 1.0
    size = F.floor(F.log("n") / step + 1e-9) if threshold < 100 else F.col("n")
    return held.join(mixed, "b").select("anchor", "rep", "comp", (F.col("comp") != F.col("anchor")).alias("stray"), size.alias("size")).distinct()


def _block_rows(strays: DataFrame) -> DataFrame:
    """Every stray of an anchor meets all members and all other strays of it whose sizes are near its own, in blocks of
    bounded size: rows (anchor, size, other, i, j, doc_id, comp, asks), where texts that ask, of one size, are compared with
    those that don't, of the other."""
    sizes = strays.groupBy("anchor", "size").agg(F.ceil(F.sum(F.col("stray").cast("int")) / BLOCK).alias("ns"),
        F.ceil(F.sum((~F.col("stray")).cast("int")) / BLOCK).alias("nm"))
    rows = strays.join(sizes, ["anchor", "size"]).withColumn("at", F.pmod(F.xxhash64("rep"), F.when(F.col("stray"), F.col("ns")).otherwise(F.greatest("nm", F.lit(1)))))
    near = F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("other")
    met_by = sizes.select("anchor", F.col("size").alias("other"), F.col("ns").alias("other_ns"), F.col("nm").alias("other_nm"))
    paired = rows.select("anchor", "rep", "comp", "stray", "size", "ns", "nm", "at", near).join(met_by, ["anchor", "other"])
    blocks = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    asks = paired.filter("stray").select("anchor", "size", "other", F.col("at").alias("i"), blocks(F.col("other_nm") + F.col("other_ns")).alias("j"),
        F.col("rep").alias("doc_id"), "comp", F.lit(True).alias("asks"))
    place = F.when(F.col("stray"), F.col("nm") + F.col("at")).otherwise(F.col("at"))
    met = paired.select("anchor", F.col("other").alias("size"), F.col("size").alias("other"), blocks(F.col("other_ns")).alias("i"), place.alias("j"),
        F.col("rep").alias("doc_id"), "comp", F.lit(False).alias("asks"))
    return asks.unionByName(met)


def _links(asks: list[tuple], met: list[tuple], threshold: int):
    """(doc_id, component, set) of texts that ask and of those they meet -> links that join components. Texts whose
    components a link of the block has joined are not compared any more, so a group of copies gives few links."""
    if not asks or not met:
        return
    joined: dict[int, int] = {}

    def root(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    roots = np.array([c for _, c, _ in met])
    for d, c, x in asks:
        own = root(c)
        others = np.flatnonzero(roots != own)
        if not len(others):
            continue
        sets = [met[k][2] for k in others.tolist()]
        n = np.array([len(y) for y in sets])
        flat = np.concatenate(sets)
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        near = np.minimum(np.searchsorted(x, flat), len(x) - 1)
        both = tx.reduce_at(np.add, (x[near] == flat).astype(np.int64), at, 0)
        for k in others[both * 100 >= threshold * (len(x) + n - both)].tolist():
            if (theirs := int(roots[k])) != own:
                yield d, met[k][0]
                joined[theirs] = own
                roots[roots == theirs] = own


def _verify_blocks(size: int, threshold: int):
    """Rows of a block (anchor, size, other, i, j) come together, and are bounded in number; yields pairs of components
    that a link joins."""

    def joined(asks: list[tuple], met: list[tuple]) -> list[tuple]:
        comp = {d: c for d, c, _ in (*asks, *met)}
        return [(comp[u], comp[v]) for u, v in _links(asks, met, threshold)]

    def run(batches):
        key, asks, met = None, [], []
        for batch, raw, at in tx.blocks(batches, "text"):
            sets, sat = tx.distinct(*tx.shingles(*tx.word_hashes(raw, at), size))
            names = [batch.column(k).to_pylist() for k in range(8)]
            out = []
            for i, (*now, doc_id, comp, asking) in enumerate(zip(*names, strict=True)):
                if now != key:
                    out += joined(asks, met)
                    key, asks, met = now, [], []
                (asks if asking else met).append((doc_id, comp, sets[sat[i] : sat[i + 1]].copy()))
            yield _pairs(out)
        yield _pairs(joined(asks, met))

    return run


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])


def _confirmed_blocks(rows: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    block = ["anchor", "size", "other", "i", "j"]
    held = rows.join(texts, "doc_id").select(*block, "doc_id", "comp", "asks", "text")
    return held.repartition(*block).sortWithinPartitions(*block).mapInArrow(_verify_blocks(size, threshold), "u long, v long")


def near_duplicates(docs: DataFrame, column: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = 5, threshold: int = 75) -> DataFrame:
    """docs(doc_id, column, ...) -> docs' doc_id with n_shingles, component_id and kept.

    Texts are linked if 100 * |A and B| >= threshold * |A or B| on their sets of word shingles; texts with equal sets
    are always linked. A text without words has an empty set and is linked with nothing. Null text: empty. A null
    doc_id takes the component of its equals, and is kept only if nothing else stands for it. Repeated rows each
    give a row, and no rows none. A very long text is worked on as a whole. Other columns are not read, whatever their
    names.
    """
    ship(docs.sparkSession)
    slim = tx.slim(docs, column)
    held = durable(slim.mapInArrow(_sketches("text", bands, rows, size), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketches")
    n = held.count()
    classes = durable(packed(held.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), n), "classes")
    reps = classes.filter("rep is not null").select("s1", "s2", F.col("n_shingles").alias("n"), "rep")
    keyed = held.join(reps, (held.doc_id == reps.rep) & (held.s1 == reps.s1) & (held.s2 == reps.s2)).select("rep", "n", "bands").dropDuplicates(["rep", "n"])
    entries = keyed.select(F.explode("bands").alias("b"), "rep", "n")
    shared = entries.groupBy("b").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("b")
    live = durable(packed(entries.join(shared, "b"), n * bands, ENTRIES), "live")
    wanted = live.select(F.col("rep").alias("doc_id")).distinct()
    texts = durable(packed(slim.join(wanted, "doc_id").dropDuplicates(), n, TEXTS), "texts")

    entered = live.count()
    pairs = durable(packed(_pivot_pairs(live), entered, ENTRIES), "pairs")
    links = durable(packed(_confirmed(pairs, texts, size, threshold), 2 * pairs.count(), TEXTS), "links")
    discard(pairs)
    linked = links.count()
    groups = durable(packed(components(links, rows=linked), 2 * linked), "groups")
    rest = durable(packed(_strays(live, groups, threshold), entered, ENTRIES), "strays")
    named = classes.join(groups, classes.rep == groups.id, "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    if rest.head(1):
        more = durable(_confirmed_blocks(_block_rows(rest), texts, size, threshold), "links")
        linked = more.count()
        whole = durable(packed(components(more, rows=linked), 2 * linked), "groups").select("id", F.col("component").alias("whole"))
        named = named.join(whole, named.component_id == whole.id, "left").select("s1", "s2", "n_shingles", F.coalesce("whole", "component_id").alias("component_id"))
        discard(more)
    discard(live, texts, links, rest)

    out = held.drop("bands").join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))
