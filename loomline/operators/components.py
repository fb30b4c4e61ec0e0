"""Connected components by alternating large-star and small-star contraction.

Every round is a min-aggregation and an equi-join, so no vertex's neighbourhood is gathered in one place, and the
number of rounds is logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import discard, durable, packed


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """edges(u, v) of any ordered type -> (id, component) for every vertex of an edge, component being the smallest
    vertex that can be reached. Self-loops give their vertex a row; nulls are ignored. No edges: no rows. If the number
    of edges is given as rows, the tables of the rounds, which have no more, are packed by it."""
    pairs = edges.select("u", "v").filter("u is not null and v is not null")
    loops = pairs.filter("u = v").select("u")
    work = durable(packed(pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows), "edges")
    before = _mark(work)
    for _ in range(max_rounds):
        if not before[0]:
            break
        old, work = work, durable(packed(_small_star(_large_star(work).distinct()).distinct(), None if rows is None else before[0]), "stars")
        after = _mark(work)
        discard(old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = work.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = work.select(F.col("v").alias("id"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return leaves.unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))
