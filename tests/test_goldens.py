"""Known results on small inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomline import lifecycle as lc
from loomline.functions import protocol as p
from loomline.functions.udf import Registry, identity, scaled
from loomline.operators import cluster as cl
from loomline.operators import control as c
from loomline.operators import metrics as m
from loomline.operators import tensor as t
from loomline.operators import topology as g
from loomline.operators.components import components
from loomline.sources import tables as s


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "key long, seq long, x double")


def test_metrics_key_total_and_gauge(spark):
    rows = spark.createDataFrame([({"zone": "a", "tenant": "t1"}, 1, 0.5), ({"tenant": "t1", "zone": "a"}, 2, 0.7)], "labels map<string,string>, seq long, v double")
    keyed = rows.withColumn("key", m.series_key(F.lit("requests"), F.col("labels")))
    assert [tuple(r) for r in m.counter_totals(keyed, "key").collect()] == [("requests_tenant=t1_zone=a", 2)]
    assert m.gauge_last(keyed, "key", "v", ["seq"]).first().value == 0.7
    lines = [r.line for r in m.exposition(m.counter_totals(keyed, "key"), m.gauge_last(keyed, "key", "v", ["seq"])).orderBy("part", "line").collect()]
    assert lines == ["requests_tenant=t1_zone=a 2", "requests_tenant=t1_zone=a 0.7"]


def test_service_level(spark):
    rows = spark.createDataFrame([(True,), (True,), (False,)], "ok boolean")
    assert rows.agg(m.sli(F.col("ok"))).first()[0] == pytest.approx(2 / 3)
    assert rows.filter("false").agg(m.sli(F.col("ok"))).first()[0] == 1.0
    many = spark.range(1005).select(F.lit(1).alias("k"), F.col("id").alias("seq"), F.col("id").cast("double").alias("latency"), (F.col("id") % 2 == 0).alias("ok"))
    assert m.p95_recent(many, ["k"], "latency", ["seq"]).first().p95 == 955
    assert many.agg(m.sli(F.col("ok"))).first()[0] == 503 / 1005
    assert m.at_rank(series(spark, range(20)), ["key"], "x", {"p95": 0.95}).first().p95 == 19.0
    with pytest.raises(ValueError, match="one sample"):
        m.recent(many, ["k"], ["seq"], 0)


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_ranks_are_exact_whatever_the_sketch(spark, monkeypatch, accuracy):
    monkeypatch.setattr(m, "ACCURACY", accuracy)
    rnd = random.Random(5)
    values = {k: [float(rnd.choice([rnd.randrange(5), rnd.uniform(0, 100)])) for _ in range(n)] for k, n in ((1, 1), (2, 7), (3, 4000), (4, 20))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(3, None)], "k long, x double")
    wanted = {"lowest": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}
    want = {k: tuple(sorted(vs)[min(int(q * len(vs)), len(vs) - 1)] for q in wanted.values()) for k, vs in values.items()}
    assert {r.k: tuple(r)[1:] for r in m.at_rank(df, ["k"], "x", wanted).collect()} == want
    assert {r.k: tuple(r)[1:] for r in m.at_rank_of_few(df, ["k"], "x", wanted).collect()} == want


def test_longest_streak(spark):
    rows = spark.createDataFrame([(1, i, bool(b)) for i, b in enumerate([1, 1, 0, 1, 1, 1, 1, 0, 1])], "k long, seq long, f boolean")
    assert m.longest_streak(rows, ["k"], ["seq"], F.col("f")).first().longest == 4


def test_pid_goldens(spark):
    rows = series(spark, [0.1, 0.0, -0.1])
    assert [r.epsilon for r in c.pid_trace(rows, "key", ["seq"], "x").orderBy("seq").collect()] == pytest.approx([0.41, 0.43, 0.51], abs=1e-12)
    own = c.Pid(0.1, 0.01, 0.2, 0.1, 0.9)
    assert c.pid_final(series(spark, [0.1]), "key", ["seq"], "x", own).first().epsilon == pytest.approx(0.469)
    assert [c.pid_final(series(spark, [v]), "key", ["seq"], "x", own).first().epsilon for v in (-100, 100)] == [0.9, 0.1]
    held = c.pid_trace(series(spark, [10.0] * 50), "key", ["seq"], "x", c.Pid(low=0.01)).collect()
    assert all(0.01 <= r.epsilon <= 1 for r in held)


def test_pid_equals_plain_steps(spark):
    rnd = random.Random(1)
    pid = c.Pid()
    at = (0.0, 0.0, pid.start)
    values = [rnd.uniform(-3, 3) for _ in range(300)]
    for v in values:
        at = pid.step(*at, v)
    r = c.pid_final(series(spark, values), "key", ["seq"], "x").first()
    assert (r.integral, r.error, r.epsilon) == at


def test_oscillation_variance_and_warmup(spark):
    rows = series(spark, [0.5, 0.6, 0.5, 0.6])
    assert c.oscillation(rows, "key", ["seq"], "x").first().oscillates
    assert rows.groupBy("key").agg(c.series_variance("x").alias("v")).first().v == pytest.approx(0.0025)
    one = series(spark, [1.0])
    assert not c.oscillation(one, "key", ["seq"], "x").first().oscillates and one.agg(c.series_variance("x")).first()[0] == 0.0
    assert c.warmup(series(spark, [0.0] * 20), "key", ["seq"], "x", 0.01).first().spikes_used == 10
    assert c.warmup(series(spark, [0.1 / k for k in range(1, 201)]), "key", ["seq"], "x", 0.01).first().spikes_used == 10
    never = c.warmup(series(spark, [i * 10.0 for i in range(15)]), "key", ["seq"], "x", 0.01).first()
    assert never.spikes_used == 15 and never.converged


def test_active_count_never_below_zero(spark):
    rnd = random.Random(2)
    changes = [rnd.choice([1, -1, -1, 0]) for _ in range(200)]
    now, want = 0, []
    for x in changes:
        now = max(0, now + x)
        want.append(now)
    got = c.active_count(series(spark, changes), "key", ["seq"], "x").orderBy("seq").collect()
    assert [r.active for r in got] == want


def weights(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "key long, idx int, w double")


def test_tensor(spark):
    norm = lambda v, target: t.normalize(weights(spark, v), "key", ["idx"], "w", target).orderBy("idx").collect()
    assert sum(r.normalized for r in norm([25] * 4, 100.0)) == pytest.approx(100)
    assert {r.status for r in norm([0, 0, 0], 100.0)} == {"ZeroVolume"}
    assert norm([1], 2 * t.MOST)[0].status == "Overflow" and norm([1], 2.2250738585072014e-308)[0].status == "Underflow"
    largest = lambda v: t.normalize_clamped_max(weights(spark, v), "key", "w", 1.0).first().largest
    assert largest([1e20, 1e30, 1e40]) <= t.MOST and largest([0]) == 0.0
    within = lambda v: weights(spark, v).agg(t.within_bounds("w")).first()[0]
    assert within([0, 1]) and not within([-1]) and not within([math.nan]) and within([])
    stable = lambda v, target: spark.range(1).select(t.volume_stable(F.lit(v), target, 0.01)).first()[0]
    assert stable(100.0, 100.0) and not stable(90.0, 100.0) and not stable(1.0, 0.0) and stable(1.0, -5.0)


def graph(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    nodes = df.select(F.col("a").alias("id")).union(df.select("b")).distinct()
    return nodes, g.canonical(df)


def test_graph(spark):
    r = g.betti(*graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])).first()
    assert (r.n_edges, r.n_triangles, r.betti_ref, r.n_components) == (3, 1, 2, 1)
    assert g.betti(*graph(spark, [("a", "b"), ("c", "d")])).first().n_components == 2
    empty = g.betti(*(x.filter("false") for x in graph(spark, [("a", "b")]))).first()
    assert (empty.n_edges, empty.n_triangles, empty.betti_ref) == (0, 0, 0)
    name = lambda i: f"n{i % 150:03d}"
    ring = [(name(i + d), name(i + e)) for i in range(150) for d, e in ((0, 1), (1, 2), (2, 0))]
    r = g.betti(*graph(spark, ring)).first()
    assert (r.n_edges, r.n_triangles, r.betti_ref) == (300, 150, 301)
    assert g.edge_count(g.canonical(spark.createDataFrame([("a", "a"), ("a", "b")], "a string, b string"))).first().n_edges == 1


def test_removed_edges_leave_nodes(spark):
    rows = [(1, "a", "b", True), (2, "b", "c", True), (3, "a", "c", False), (4, "b", "a", False)]
    nodes, edges = g.live_edges(spark.createDataFrame(rows, "seq long, a string, b string, added boolean"))
    r = g.betti(nodes, edges).first()
    assert (r.n_nodes, r.n_edges, r.n_components, r.betti_ref) == (3, 1, 2, -1)


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 500), (None, 1)], "u long, v long")
    out = {r.id: r.component for r in components(df).collect()}
    assert set(out.values()) == {0, 500} and len(out) == 201
    assert components(df.filter("false")).count() == 0
    assert g.spikes(spark, 5).collect()[4][1:] == ("node-1", "node-2")


def test_cluster(spark):
    rows = spark.createDataFrame([(1, 5, 1, "x"), (1, 5, 2, "y"), (2, 1, 1, "old"), (2, 3, 2, "new")], "id long, hb long, seq long, v string")
    assert {r.id: r.v for r in cl.gossip_merge(rows, "id", "hb", "seq").collect()} == {1: "x", 2: "new"}
    routes = spark.createDataFrame([("p", None, 1), ("t", "p", 2)], "target string, next_hop string, distance int")
    hops = {r.target: r.hop for r in cl.next_hops(spark.createDataFrame([("p",), ("t",), ("u",)], "target string"), routes).collect()}
    assert hops == {"p": "p", "t": "p", "u": None}
    after = {r.target: (r.next_hop, r.distance) for r in cl.update_routes(routes, spark.createDataFrame([("t",), ("me",)], "target string"), F.lit("me")).collect()}
    assert after == {"p": (None, 1), "t": (None, 1)}
    one = spark.createDataFrame([(1, "Ready"), (2, "Failed")], "id long, state string")
    assert cl.allocate(one, 100).count() == 1
    assert one.filter("false").agg(cl.convergence(cl.alive("state"))).first()[0] == 1.0


def test_protocol(spark):
    v = lambda a, b, d: F.struct(F.lit(a).alias("major"), F.lit(b).alias("minor"), F.lit(d).alias("patch"))
    r = spark.range(1).select(p.compatible(v(1, 0, 0), v(1, 1, 0)), p.compatible(v(1, 0, 0), v(2, 0, 0)), p.newer(v(1, 1, 0), v(1, 0, 0)),
        p.newer(v(2, 0, 0), v(1, 9, 9)), p.newer(v(1, 0, 0), v(1, 0, 0))).first()
    assert tuple(r) == (True, False, True, True, False)


def test_functions(spark):
    registry = Registry()
    registry.register("f", identity)
    registry.register("f", scaled("id", 2))
    assert len(registry) == 1
    df = spark.range(10)
    assert registry.apply("f", df).collect() == df.collect()
    with pytest.raises(lc.FunctionError, match="not found"):
        registry.apply("g", df)
    with pytest.raises(lc.FunctionError):
        registry.register("h", b"bytes")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id long, value double")
    files = s.terminal(df, str(tmp_path / "out"))
    assert files and all("part-" in f for f in files)
    assert s.receive(spark, str(tmp_path / "out"), df.schema).count() == 3
    with pytest.raises(lc.SchemaError, match="missing"):
        s.receive(spark, str(tmp_path / "out"), spark.range(1).withColumnRenamed("id", "x").schema)
    with pytest.raises(lc.SchemaError, match="not string"):
        s.receive(spark, str(tmp_path / "out"), df.selectExpr("string(id) id").schema)
    with pytest.raises(Exception, match="has a null"):
        s.reject_nulls(df, "value").collect()
    assert sorted(s.from_ipc(s.to_ipc(df), df.schema).collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="(?i)arrow"):
        s.from_ipc(spark.createDataFrame([(bytearray(b"not-arrow"),)], "ipc binary"), df.schema).collect()
    parted = s.terminal(df, str(tmp_path / "parted"), ["id"])
    assert any("id=2/" in f for f in parted)
    assert s.sensors(spark, 60).orderBy("id").collect()[51] == (51, 51 * 0.12345, "sensor_0001")


def test_control(spark, tmp_path):
    control = lc.Control(spark)
    stages = [("receptor", lambda d: d.filter("id < 8")), ("aggregation", lambda d: d.groupBy((F.col("id") % 2).alias("k")).count())]
    job = control.submit(stages, lc.JobConfig(output_path=str(tmp_path / "job"), idempotency_key="request-1", tenant="t"))
    assert control.submit(stages, lc.JobConfig(idempotency_key="request-1", tenant="t")) == job and control.status(job) == "pending"
    assert control.submit(stages, lc.JobConfig(idempotency_key="request-1", tenant="another")) != job
    with pytest.raises(lc.InvalidState):
        control.cancel(job)
    assert control.run(job, spark.range(10)).count() == 2
    assert control.status(job) == "completed" and control.job(job).rows == {"receptor": 8, "aggregation": 2}
    with pytest.raises(lc.InvalidState):
        control.run(job, spark.range(1))
    with pytest.raises(lc.GraphNotFound, match="Graph not found: x"):
        control.status("x")
    bad = control.submit([("boom", lambda d: d.select("nothing"))])
    with pytest.raises(Exception, match="nothing"):
        control.run(bad, spark.range(1))
    assert control.status(bad).startswith("failed: ")


def test_admission(spark):
    control = lc.Control(spark, require_credentials=True)
    with pytest.raises(lc.AuthenticationRequired):
        control.submit([])
    control.tenants.set("t", lc.Quota(max_concurrent=1))
    control.submit([], lc.JobConfig(tenant="t", credentials="x"))
    with pytest.raises(lc.QuotaExceeded):
        control.submit([], lc.JobConfig(tenant="t", credentials="x"))
    tenants = lc.Tenants()
    tenants.set("t", lc.Quota(max_concurrent=1))
    assert tenants.can_start("t")
    tenants.start("t")
    assert not tenants.can_start("t")
    tenants.end("t")
    tenants.end("t")
    assert tenants.can_start("t")
    with pytest.raises(lc.UnknownTenant):
        tenants.can_start("u")


def test_command_line(capsys):
    from loomline.__main__ import main

    assert main(["list"]) == 0 and "triangles" in capsys.readouterr().out
    assert main(["sql", "edge_count"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["run", "nothing"]) == 2
