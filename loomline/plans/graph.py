"""Topology of the purchase graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import topology as g
from loomline.plans.bindings import EDGES, NODES, PAIRS, purchase_pairs
from loomline.session import table


def _graph(spark, sf_dir):
    nodes = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("id")).distinct()
    return nodes, g.canonical(purchase_pairs(spark, sf_dir)).filter("u <> v")


def edge_set(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


def edge_count(spark, sf_dir):
    return g.edge_count(_graph(spark, sf_dir)[1])


def edge_count_with_loops(spark, sf_dir):
    """Users who purchase twice in a row are edges to themselves, which add one to the sum of degrees."""
    return g.edge_count(g.canonical(purchase_pairs(spark, sf_dir)))


def triangles(spark, sf_dir):
    return g.triangles(_graph(spark, sf_dir)[1])


def betti_ref(spark, sf_dir):
    return g.betti(*_graph(spark, sf_dir))


def partitions(spark, sf_dir):
    return g.partitions(*_graph(spark, sf_dir))


def live_edges(spark, sf_dir):
    """Every pair of purchases adds an edge; every third pair of users takes its own away again."""
    pairs = purchase_pairs(spark, sf_dir).filter("a <> b").distinct()
    changes = pairs.select(F.lit(1).alias("seq"), "a", "b",
        F.lit(True).alias("added")).unionByName(pairs.filter("(a + b) % 3 = 0").select(F.lit(2).alias("seq"), "a", "b", F.lit(False).alias("added")))
    nodes, edges = g.live_edges(changes)
    one = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return one.join(nodes.agg(F.count(F.lit(1)).alias("n_nodes")))  # one row each


def synthetic_spikes(spark, sf_dir):
    return g.spikes(spark, 1000)


_TRI = "t AS (SELECT e1.u AS a, e1.v AS b, e2.v AS c FROM edges e1 JOIN edges e2 ON e1.v = e2.u JOIN edges e3 ON e3.u = e1.u AND e3.v = e2.v)"
_REACH = "b2 AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), r(id, x) AS (SELECT id, id FROM nodes UNION SELECT r.id, b2.v FROM r JOIN b2 ON r.x = b2.u)"
QUERIES = {f.__name__: f for f in (edge_set, edge_count, edge_count_with_loops, triangles, betti_ref, partitions, live_edges, synthetic_spikes)}
ORACLES = {
    "edge_set": f"WITH {EDGES} SELECT u, v FROM edges",
    "edge_count": f"WITH {EDGES} SELECT count(*) AS n_edges FROM edges",
    "edge_count_with_loops": f"WITH {PAIRS}, e AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM pairs WHERE b IS NOT NULL) SELECT "
        f"CAST(floor(sum(CASE WHEN u = v THEN 1 ELSE 2 END) / 2) AS BIGINT) AS n_edges FROM e",
    "triangles": f"WITH {EDGES}, {_TRI} SELECT a, b, c FROM t",
    "betti_ref": f"WITH RECURSIVE {EDGES}, {NODES}, {_TRI}, {_REACH}, c AS (SELECT count(DISTINCT m) AS c FROM (SELECT id, min(x) AS m FROM r GROUP "
        f"BY 1)), n AS (SELECT (SELECT count(*) FROM nodes) AS v, (SELECT count(*) FROM edges) AS e, (SELECT count(*) FROM t) AS t) SELECT v AS "
        f"n_nodes, e AS n_edges, t AS n_triangles, c AS n_components, CASE WHEN v > 0 THEN e - v + t + 1 ELSE 0 END AS betti_ref, e - v + c "
        f"AS cyclomatic FROM n, c",
    "partitions": f"WITH RECURSIVE {EDGES}, {NODES}, {_REACH} SELECT id, min(x) AS component FROM r GROUP BY 1",
    "live_edges": f"WITH {EDGES} SELECT (SELECT count(*) FROM edges WHERE (u + v) % 3 <> 0) AS n_edges, (SELECT count(*) FROM (SELECT u FROM edges "
        f"UNION SELECT v FROM edges)) AS n_nodes",
    "synthetic_spikes": "SELECT range AS id, 'node-' || (range % 3) AS source, 'node-' || ((range + 1) % 3) AS target FROM range(1000)",
}
