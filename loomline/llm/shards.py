"""Sharding by histogram sort.

Documents are ordered by a hash of their text, so that equal texts stand together, and then by doc_id. Splitters of
that order are found by counting: each round counts the exact bytes between candidate boundaries (probes) over all
partitions, keeps for each splitter the gap between probes in which its target lies, and probes that gap more finely,
until a boundary is within tolerance. Then every row knows its shard, and rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm import text as tx
from loomline.session import discard, durable, ship

#: Probes of each splitter in a round, and how far from its target, as a share of a shard, a splitter may be; and how
#: far it may be for not to cut a group of equal texts.
PROBES, TOLERANCE, GROUP_TOLERANCE = 256, 0.002, 0.01
#: Rows that are numbered together, and groups of a shard that are numbered apart at most; beyond these, groups grow.
SLOT_ROWS, MOST_GROUPS = 50_000, 1 << 14
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_GAP = "within long, gap int, bytes long, low long, high long"


def _counts(probes: dict[int | None, list[int]]):
    """Bytes, least and greatest value in each gap between probes: of keys, or of the doc_ids within a key."""

    def run(batches):
        for batch in batches:
            key, doc_id, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for within, edges in probes.items():
                own = slice(None) if within is None else key == within
                value, own_size = (key if within is None else doc_id)[own], size[own]
                if not len(value):
                    continue
                order = np.argsort(value)
                value, own_size = value[order], own_size[order]
                gap = np.searchsorted(np.array(edges, np.int64), value, "left")
                first = np.flatnonzero(np.append(True, gap[1:] != gap[:-1]))
                last = np.append(first[1:], len(gap)) - 1
                columns = [gap[first].astype(np.int32), np.add.reduceat(own_size, first), value[first], value[last]]
                yield pa.RecordBatch.from_arrays([pa.array([within] * len(first), pa.int64()), *map(pa.array, columns)], ["within", "gap", "bytes", "low", "high"])

    return run


def _gaps(sizes: DataFrame, probes: dict[int | None, list[int]]) -> dict[int | None, list[tuple[int, int, int, int]]]:
    """For each group of probes its gaps that have rows, in order: (bytes up to the gap, bytes up to its end, least and
    greatest value in it). Exact, over all partitions; as many rows as probes come to the driver at most."""
    found = sizes.mapInArrow(_counts(probes), _GAP).groupBy("within", "gap").agg(F.sum("bytes"), F.min("low"), F.max("high")).collect()
    out: dict[int | None, list] = {within: [] for within in probes}
    for within, _, n, low, high in sorted(found, key=lambda r: r[1]):
        under = out[within][-1][1] if out[within] else 0
        out[within].append((under, under + n, low, high))
    return out


def _refine(sizes: DataFrame, targets: list[tuple[int | None, float]], near: float) -> list[tuple[int, int, int]]:
    """For each target (within, bytes), (boundary, bytes at or below it, bytes below it): of keys (within is None) or of
    the doc_ids within a key, those up to the boundary come before the splitter. A boundary within `near` of the target,
    or the single value at which the count leaps over it. All targets are probed in the same rounds."""
    ends = [(_LOW, _HIGH, 0) for _ in targets]  # least and greatest value in question, bytes below them
    found: list = [None] * len(targets)
    while any(f is None for f in found):
        probes: dict[int | None, set[int]] = {}
        for (within, _), (low, high, _), f in zip(targets, ends, found, strict=True):
            if f is None:
                probes.setdefault(within, set()).update(low + (high - low) * k // PROBES for k in range(PROBES + 1))
        gaps = _gaps(sizes, {w: sorted(p) for w, p in probes.items()})
        for i, (within, target) in enumerate(targets):
            if found[i] is not None:
                continue
            rows = gaps[within]
            n, at = min((abs(r[1] - target), k) for k, r in enumerate(rows))
            if n <= near:
                found[i] = (rows[at][3], rows[at][1], rows[at][1])
                continue
            k = min(bisect_left(rows, target, key=lambda r: r[1]), len(rows) - 1)
            under, upto, low, high = rows[k]
            ends[i] = (low, high, under)
            if low == high:
                found[i] = (low, upto, under)
    return found


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """sizes(key, doc_id, size) -> shards - 1 boundaries (key, doc_id): rows up to a boundary, in order of (key,
    doc_id), come before it. Where equal keys leap over a target, their group is cut by doc_id, or left whole if that
    takes the splitter no more than GROUP_TOLERANCE off."""
    total = (_gaps(sizes, {None: [_HIGH]})[None] or [(0, 0, 0, 0)])[0][1]
    if not total:
        return [(_HIGH, _HIGH)] * (shards - 1)
    targets = [total * i / shards for i in range(1, shards)]
    near = total / shards * tolerance
    out, cut = [], []
    for i, (target, (key, upto, under)) in enumerate(zip(targets, _refine(sizes, [(None, t) for t in targets], near), strict=True)):
        best = min((abs(upto - target), 0), (abs(under - target), 1))
        out.append((key - (best[1] if upto != under else 0), _HIGH))
        if upto != under and best[0] > total / shards * GROUP_TOLERANCE:
            cut.append((i, key, target - under))
    for (i, key, target), (doc, n, less) in zip(cut, _refine(sizes, [(key, t) for _, key, t in cut], near), strict=True):
        out[i] = (key, doc) if abs(n - target) <= abs(less - target) else (key, doc - 1)
    return out


def assign(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, column: str = "text") -> DataFrame:
    """docs(doc_id, column, ...) -> docs' columns with size, text_crc32, law, shard, slot and grown_shard.

    Law `bytes`: shards' sizes (UTF-8 bytes of the text plus 1; null: 1) are within tolerance of equal, as far as
    single rows allow. Equal texts share a shard unless that would take a splitter more than GROUP_TOLERANCE off. Rows
    that are equal in doc_id and text can't be parted. A null doc_id counts as the lowest. slot numbers a shard's rows
    without gaps from 0, by groups of hashes and in these by doc_id. Columns named like the new ones are replaced;
    others stay, whatever their names. A very long text counts as any other. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    held, (own, text) = tx.positional(docs, "doc_id", column)
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = held.withColumns({
        "size": (F.octet_length(plain) + 1).cast("long"), "text_crc32": F.crc32(plain.cast("binary")).cast("long"), "key": F.xxhash64(plain),
        "id": F.coalesce(F.col(own).cast("long"), F.lit(_LOW))})
    sizes = durable(rows.select("key", "id", "size"), "sizes")
    groups = min(sizes.count() // (shards * SLOT_ROWS) + 1, MOST_GROUPS)
    shard = F.lit(0)
    for key, doc in splitters(sizes, shards, tolerance):
        shard = shard + ((F.col("key") > key) | ((F.col("key") == key) & (F.col("id") > doc))).cast("int")
    group = F.pmod(F.xxhash64("id", "key"), F.lit(groups)).cast("int")
    counted = durable(sizes.select(shard.alias("shard"), group.alias("group")).groupBy("shard", "group").agg(F.count(F.lit(1)).alias("n")), "groups")
    discard(sizes)
    starts = counted.select("shard", "group", (F.sum("n").over(Window.partitionBy("shard").orderBy("group")) - F.col("n")).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "group").orderBy("id", "key")) - 1
    placed = rows.withColumns({"shard": shard, "group": group}).withColumn("within", within).join(F.broadcast(starts),
        ["shard", "group"])  # shards * MOST_GROUPS rows at most
    kept = [i for i, n in enumerate(docs.columns) if n.lower() not in new]
    out = placed.select(
        *[f"c{i}" for i in kept], "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
    return out.toDF(*[docs.columns[i] for i in kept], *new)


def write(docs: DataFrame, path: str, shards: int = 8, column: str = "text") -> None:
    """One folder of Parquet files for each shard, rows in order of slot within each file. Texts are exchanged once, as
    rows are numbered; edges are as in assign(), and an empty table gives an empty folder."""
    assign(docs, shards, column=column).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
