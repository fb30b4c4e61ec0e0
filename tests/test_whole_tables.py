"""Queries over whole tables: no row is left out on the way in."""

import datetime
import itertools

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of tables: events(user, type, value) a minute apart in one file, and customers 1 to 6."""

    def make(rows):
        events = [(i, START + datetime.timedelta(minutes=i), u, t, float(v), '{"k": 1}') for i, (u, t, v) in enumerate(rows)]
        frame = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        frame.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
        spark.range(1, 7).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
        return str(tmp_path)

    return make


def test_node_states_replays_events_of_all_nodes(spark, tables):
    path = tables([(1, "error", 1), (2, "error", 1), (3, "purchase", 1), (4, "error", 1), (4, "signup", 1), (5, "view", 1), (9, "error", 1)])
    got = {r.id: r.state for r in entry.queries()["node_states"](spark, path).collect()}
    assert got == {1: "Failed", 2: "Failed", 3: "Executing", 4: "Ready", 5: "Ready", 6: "Ready"}


def test_purchase_graph_takes_every_purchase(spark, tables):
    """Against brute force; most values are small, and users 7 and 8 buy small things only."""
    users = [1, 2, 3, 1, 4, 5, 4, 6, 7, 8, 7, 7, 2, 5, 3, 1, 8, 6]
    path = tables([(u, "purchase", 90 if i % 5 == 0 and u < 7 else i) for i, u in enumerate(users)] + [(9, "view", 99)])
    pairs = list(itertools.pairwise(users))
    edges = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
    triangles = {t for t in itertools.combinations(sorted(set(users)), 3) if edges.issuperset(itertools.combinations(t, 2))}
    component = {u: u for u in users}
    for _ in users:
        for u, v in edges:
            component[u] = component[v] = min(component[u], component[v])
    run = lambda name: [tuple(r) for r in entry.queries()[name](spark, path).collect()]
    assert sorted(run("edge_set")) == sorted(edges) and run("edge_count") == [(len(edges),)]
    assert triangles and sorted(run("triangles")) == sorted(triangles)
    assert sorted(run("partitions")) == sorted(component.items())
    v, e, t, c = len(set(users)), len(edges), len(triangles), len(set(component.values()))
    assert run("betti_ref") == [(v, e, t, c, e - v + t + 1, e - v + c)]
    assert run("live_edges") == [(sum((a + b) % 3 != 0 for a, b in edges), v)]
