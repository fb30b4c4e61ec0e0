"""Undirected graphs as tables: nodes(id) and edges(u < v), self-loops apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.components import components
from loomline.session import durable


def canonical(pairs: DataFrame) -> DataFrame:
    """(a, b) of any direction and count -> edges(u, v) with u <= v, once each."""
    return pairs.filter("a is not null and b is not null").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def live_edges(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, a, b, added) -> nodes and edges after all changes; a removed edge leaves its ends as nodes."""
    edges = changes.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "seq", "added")
    last = edges.groupBy("u", "v").agg(F.max_by("added", "seq").alias("added"))
    ends = changes.filter("added")
    nodes = ends.select(F.col("a").alias("id")).unionByName(ends.select(F.col("b").alias("id"))).distinct()
    return nodes, last.filter("added").select("u", "v")


def edge_count(edges: DataFrame) -> DataFrame:
    """floor((2 * E + L) / 2): a self-loop adds 1 to the sum of degrees."""
    ends = F.sum(F.when(F.col("u") == F.col("v"), 1).otherwise(2))
    return edges.agg(F.floor(F.coalesce(ends, F.lit(0)) / 2).cast("long").alias("n_edges"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c, once each. Edges run from the end of lower degree to the other, so that a node of very
    many edges starts few paths."""
    proper = edges.filter("u <> v")
    ends = proper.select(F.col("u").alias("id")).unionByName(proper.select(F.col("v").alias("id")))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    du, dv = (degree.select(F.col("id").alias(x), F.col("d").alias(f"d{x}")) for x in "uv")
    known = proper.join(du, "u").join(dv, "v")
    up = F.struct("du", "u") < F.struct("dv", "v")
    ways = durable(known.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y")), "ways")
    first, second = ways, ways.select("x", F.col("y").alias("z"))
    wedge = first.join(second, "x").filter("y < z")
    closed = wedge.join(proper, (F.col("y") == F.col("u")) & (F.col("z") == F.col("v")), "left_semi")
    run = F.array_sort(F.array("x", "y", "z"))
    return closed.select(run[0].alias("a"), run[1].alias("b"), run[2].alias("c"))


def partitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node; nodes without edges are components of their own."""
    found = components(edges)
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def betti(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: betti_ref, which is E - V + T + 1 (0 without nodes), and the cyclomatic number E - V + C. The edges are
    written once, as they are read by counts, triangles and components. Components are counted as roots: nodes that are
    their own component, and those without an edge."""
    held = durable(edges, "edges")
    found = components(held)
    sums = found.agg(F.count(F.lit(1)).alias("linked"), F.sum((F.col("id") == F.col("component")).cast("long")).alias("roots"))
    v = nodes.agg(F.count(F.lit(1)).alias("v"))
    t = triangles(held).agg(F.count(F.lit(1)).alias("t"))
    one = edge_count(held).join(v).join(t).join(sums)  # four tables of one row each
    c = F.col("v") - F.col("linked") + F.coalesce("roots", F.lit(0))
    ref = F.when(F.col("v") > 0, F.col("n_edges") - F.col("v") + F.col("t") + 1).otherwise(F.lit(0))
    return one.select(F.col("v").alias("n_nodes"), "n_edges", F.col("t").alias("n_triangles"), c.alias("n_components"),
        ref.cast("long").alias("betti_ref"), (F.col("n_edges") - F.col("v") + c).alias("cyclomatic"))


def spikes(spark, n: int) -> DataFrame:
    """Synthetic load: (id, source, target) on a ring of three nodes."""
    name = lambda c: F.format_string("node-%d", c)
    return spark.range(n).select("id", name(F.col("id") % 3).alias("source"), name((F.col("id") + 1) % 3).alias("target"))
