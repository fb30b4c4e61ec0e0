"""Fixed texts of errors, admission under every limit, nodes, clients, the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomline import errors as e
from loomline import lifecycle as lc
from loomline.functions import protocol as p
from loomline.operators import control as c
from loomline.operators import metrics as m
from loomline.operators import tensor as t


@pytest.mark.parametrize(("error", "text"), [
    (e.GraphNotFound("graph-123"), "Graph not found: graph-123"), (e.ExecutionFailed("timeout"), "Execution failed: timeout"),
        (e.FunctionError("out of fuel"), "Wasm runtime error: out of fuel"),
    (e.DataPlaneError("connection lost"), "Data plane error: connection lost"),
        (e.SerializationError("invalid json"), "Serialization error: invalid json"), (e.StorageError("disk"), "IO error: disk"),
    (e.ParquetError("write failed"), "Parquet error: write failed"), (e.ArrowError("schema mismatch"), "Arrow error: schema mismatch"),
    (e.InvalidState("graph already running"), "Graph not in valid state for operation: graph already running"),
        (e.QuotaExceeded("memory limit"), "Resource quota exceeded: memory limit"),
    (e.AuthenticationRequired(), "Authentication required"), (e.AuthorizationFailed("invalid token"), "Authorization failed: invalid token"),
    (e.IdempotencyKeyExists("key-123"), "Idempotency key already exists: key-123"),
        (e.ProtocolVersionMismatch("1.0.0", "0.9.0"), "Protocol version mismatch: expected 1.0.0, got 0.9.0"),
    (e.RequestFailed("x"), "Request failed: x"), (e.ServerError("x"), "Server error: x"), (e.ClientGraphNotFound("x"), "Graph not found: x"),
        (e.ClientAuthenticationRequired(), "Authentication required"),
    (e.VersionMismatch("1.0.0, 2.0.0", "3.0.0"), "Protocol version mismatch: expected one of 1.0.0, 2.0.0, got 3.0.0"), (e.InvalidMessage("x"), "Invalid message: x"),
    (e.MessageSerialization("x"), "Serialization error: x"), (e.UnsupportedMessageType("x"), "Unsupported message type: x"),
])
def test_texts(error, text):
    assert str(error) == text


def test_fourteen_errors_of_jobs():
    own = {x for x in vars(e).values() if isinstance(x, type) and e.JobError in x.__bases__}
    assert len(own) == 14


def test_messages():
    assert len(p.MESSAGES) == len(set(p.MESSAGES)) == 12
    p.validate_version((1, 4, 0), [(1, 0, 0), (2, 0, 0)])
    with pytest.raises(e.VersionMismatch, match="expected one of 1.0.0, 2.0.0, got 3.0.0"):
        p.validate_version((3, 0, 0), [(1, 0, 0), (2, 0, 0)])
    p.validate_kind("Heartbeat")
    with pytest.raises(e.UnsupportedMessageType, match="Negotiate"):
        p.validate_kind("Negotiate")


def test_every_limit_of_a_tenant(spark):
    now = [1000.0]
    control = lc.Control(spark, clock=lambda: now[0])
    config = lc.submit_graph("t").with_config(max_fuel=10)

    def refused(quota, *configs):
        control.tenants = lc.Tenants()
        control.tenants.set("t", quota)
        for x in configs[:-1]:
            control.submit([], x)
        with pytest.raises(lc.QuotaExceeded) as found:
            control.submit([], configs[-1])
        return str(found.value)

    assert refused(lc.Quota(max_concurrent=1), config, config).endswith("Tenant t has reached maximum concurrent graphs")
    assert refused(lc.Quota(max_memory_mb=1000), config, config).endswith("maximum memory")
    assert refused(lc.Quota(max_fuel=9), config).endswith("maximum fuel")
    quota = lc.Quota(max_concurrent=99, max_memory_mb=99999, rate_limit_per_minute=2)
    assert refused(quota, config, config, config).endswith("rate limit")
    now[0] += 61
    control.submit([], config)  # the minute is over
    assert (lc.Quota().max_concurrent, lc.Quota().max_memory_mb, lc.Quota().rate_limit_per_minute, lc.Quota().max_fuel) == (10, 4096, 100, 1_000_000)


def test_keys_stand_for_a_day_and_are_bounded(spark, monkeypatch):
    now = [0.0]
    control = lc.Control(spark, clock=lambda: now[0])
    config = lc.submit_graph("t").with_idempotency_key("k")
    first = control.submit([], config)
    now[0] = lc.KEY_TTL_S - 1
    assert control.submit([], config) == first != control.submit([], config.with_config(tenant="u"))
    now[0] = lc.KEY_TTL_S
    assert control.submit([], config) != first
    monkeypatch.setattr(lc, "MOST_KEYS", 3)
    for i in range(2):
        control.submit([], config.with_idempotency_key(f"k{i}"))
    with pytest.raises(lc.QuotaExceeded, match="idempotency keys"):
        control.submit([], config.with_idempotency_key("more"))


def test_nodes_fail_are_replaced_and_rejoin(spark):
    control = lc.Control(spark)
    own = control.nodes.own
    control.nodes.register(lc.Node("n2", capacity=lc.Capacity(8, 4096, 16)))
    assert control.nodes.rows()[0][2:5] == (4, 2048, 4)
    job = control.submit([], lc.JobConfig(required_nodes=1))
    assert control.allocation(job).nodes == (own,) and control.nodes.ready() == ["n2"]
    assert control.allocation(job).estimated_completion > control.clock() + 200
    assert control.node_failed(own, job) == ["n2"] and control.allocation(job).nodes == ("n2",) and control.nodes.ready() == []
    assert control.node_failed("n2", job) == []
    control.node_rejoined(own)
    control.node_rejoined("n3")
    assert control.nodes.ready() == [own, "n3"] and len(control.nodes.allocate(100)) == 2
    names = {r.name for r in control.metrics().collect()}
    assert {"loomline_retries", "loomline_allocation_failures"} <= names


def test_pending_jobs_can_be_aborted_and_late_ones_fail(spark, tmp_path):
    control = lc.Control(spark)
    control.tenants.set("t", lc.Quota(max_concurrent=1))
    job = control.submit([], lc.submit_graph("t"))
    control.abort(job)
    control.abort(job)
    assert control.status(job) == "cancelled" and control.tenants.can_start("t") and control.nodes.ready()
    slow = [("slow", lambda d: d.select(F.expr("reflect('java.lang.Thread', 'sleep', 3000L)").alias("x")))]
    job = control.submit(slow, lc.submit_graph("t").with_config(output_path=str(tmp_path / "out"), max_execution_ms=300))
    with pytest.raises(Exception):  # noqa: B017
        control.run(job, spark.range(8))
    assert control.status(job).startswith("failed: ") and control.tenants.can_start("t")


def test_records_are_json_and_back():
    config = lc.submit_graph("t").with_idempotency_key("k").with_config(credentials=lc.Credentials(token="x"))
    assert lc.JobConfig.from_json(config.to_json()) == config
    assert (lc.JobConfig().memory_mb, lc.JobConfig().max_fuel, lc.JobConfig().enable_simd, lc.JobConfig().output_path,
        lc.JobConfig().required_nodes) == (512, 1_000_000, True, None, 1)
    for text in ("{", "[]", json.dumps({"nothing": 1})):
        with pytest.raises(e.SerializationError):
            lc.JobConfig.from_json(text)
    a, b = lc.ExecutionContext("t", b"x"), lc.ExecutionContext("t", b"x")
    assert a.execution_id != b.execution_id


def test_client(spark):
    control = lc.Control(spark, require_credentials=True)
    with pytest.raises(e.ClientAuthenticationRequired):
        lc.Client(control).submit([])
    client = lc.Client(control, "token")
    job = client.submit([("receptor", lambda d: d)])
    assert client.status(job) == {"graph_id": job, "status": "pending", "stages_completed": [], "metrics": None}
    with pytest.raises(e.ClientGraphNotFound, match="Graph not found: x"):
        client.status("x")
    with pytest.raises(e.ServerError, match="Server error: Graph not in valid state"):
        client.cancel(job)


def test_command_line_jobs(capsys, tmp_path):
    from loomline.__main__ import main

    store = ["--store", str(tmp_path)]
    said = lambda: capsys.readouterr().out.strip()
    submit = ["submit", "allocate_nodes", "/root/testdata/sf0.001", "--tenant", "t", "--max-memory", "100", "--idempotency-key", "k", *store]
    assert main(submit) == 0
    job = said().removeprefix("Graph submitted: ")
    assert main(submit) == 0 and said().endswith(job)
    assert main(["status", job, *store]) == 0 and "Status: pending" in said()
    assert main(["cancel", job, *store]) == 1 and said() == "Graph not in valid state for operation: Graph is not running"
    assert main(["status", "none", *store]) == 1 and said() == "Graph not found: none"
    assert main(["work", *store]) == 0 and main(["jobs", *store]) == 0 and "completed allocate_nodes" in said()
    lc.JobFolder(str(tmp_path)).update(job, status="running")
    assert main(["cancel", job, *store]) == 0 and said() == f"Graph cancelled: {job}"


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, None if v is None else float(v)) for i, v in enumerate(values)], "key long, seq long, x double")


def test_feedback_reset_keeps_epsilon(spark):
    own = c.Pid(0.1, 0.01, 0.2, 0.1, 0.9)
    rows = series(spark, [0.1, -100, 100]).withColumn("again", F.col("seq") == 1)
    got = c.pid_trace(rows, "key", ["seq"], "x", own, F.col("again")).orderBy("seq").collect()
    assert [r.epsilon for r in got] == [pytest.approx(0.469), 0.9, 0.1]
    assert got[1].integral == 100 and got[1].error == 100  # nothing of the first step is left
    last = c.pid_final(rows, "key", ["seq"], "x", own, F.col("again")).first()
    assert tuple(last)[1:4] == tuple(got[-1])[2:5]


def test_final_state_equals_the_traces_last(spark):
    rnd = random.Random(4)
    rows = series(spark, [rnd.uniform(-1, 1) for _ in range(50)]).unionByName(series(spark, [0.5, None, 2], 2)).unionByName(series(spark, [1.0], 3))
    trace = c.pid_trace(rows, "key", ["seq"], "x").collect()
    want = {k: max((r for r in trace if r.key == k), key=lambda r: r.seq) for k in (1, 2, 3)}
    got = {r.key: r for r in c.pid_final(rows, "key", ["seq"], "x").collect()}
    assert {k: tuple(r)[1:4] for k, r in got.items()} == {k: tuple(r)[2:5] for k, r in want.items()}
    assert c.pid_final(rows.filter("false"), "key", ["seq"], "x").count() == 0


def test_warmup_that_fails_or_takes_too_long(spark):
    rows = series(spark, [i * 10.0 for i in range(15)]).withColumn("ms", F.col("seq") * 2)
    run = lambda failed, timeout: tuple(c.guarded_warmup(rows, "key", ["seq"], "x", 0.01, failed, F.col("ms"), timeout).first())[1:]
    assert run(F.lit(True), 5000) == (0, False, "Falha na convergência durante warm-up")
    assert run(F.lit(False), 0) == (15, False, "Warm-up excedeu timeout de 28ms")
    assert run(F.lit(False), 28) == (15, True, None)
    flat = series(spark, [1.0] * 20)
    settled = c.guarded_warmup(flat, "key", ["seq"], "x", 0.01, F.col("seq") == 12, F.col("seq"), 0).first()
    assert tuple(settled)[1:] == (10, True, None)


def test_normalisation_errors(spark):
    w = lambda values: spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "key long, idx int, w double")
    said = lambda v, target: t.normalize_error(w(v), "key", ["idx"], "w", target).first().error
    assert said([0, 0], 100.0) == "Volume total é zero, normalização impossível"
    assert said([1], 2 * t.MOST) == "Overflow: valor 8.58993459E9 excede u32::MAX"
    assert said([1], 2.2250738585072014e-308).startswith("Underflow: valor 2.225") and said([1], 2.2250738585072014e-308).endswith(" é muito pequeno")
    assert said([25] * 4, 100.0) is None


@pytest.mark.parametrize("seed", range(4))
def test_parts_change_no_result(spark, seed):
    rnd = random.Random(seed)
    rows = [(k, i, i // rnd.choice([1, 3, 7]), rnd.choice([1, -1, -1, 0]), rnd.random() < 0.7) for k in range(3) for i in range(60)]
    rows = [(k, i, i // 5 if seed % 2 else i // 17, x, f) for k, i, _, x, f in rows]
    df = spark.createDataFrame(rows, "key long, seq long, part long, x long, f boolean")
    get = lambda d, v: sorted((r.key, r.seq, r[v]) for r in d.collect())
    assert get(c.active_count(df, "key", ["seq"], "x", F.col("part")), "active") == get(c.active_count(df, "key", ["seq"], "x"), "active")
    want = {}
    for k in range(3):
        best = now = 0
        for _, _, _, _, f in sorted(r for r in rows if r[0] == k):
            now = now + 1 if f else 0
            best = max(best, now)
        want[k] = best
    for part in (None, F.col("part"), F.col("seq")):
        assert {r.key: r.longest for r in m.longest_streak(df, ["key"], ["seq"], F.col("f"), part).collect()} == want
    nexts = c.next_by_parts(df, ["key"], ["seq"], "x", F.col("part")).collect()
    by = {(k, i): x for k, i, _, x, _ in rows}
    assert {(r.key, r.seq): r.next for r in nexts} == {(k, i): by.get((k, i + 1)) for k, i in by}


def test_seven_alerts(spark):
    assert len(m.ALERTS) == 7 and sum(r[5] == "critical" for r in m.ALERTS) == 4
    df = spark.createDataFrame([(1, 0.98, 600.0, 0.02, 2, 0.9), (2, 1.0, 10.0, 0.0, 9, 0.1), (3, 0.5, 2000.0, 0.5, 3, 0.8)],
        "w int, availability double, p95 double, error_rate double, healthy_nodes int, quota_usage double")
    got = {}
    for r in m.raised(df, ["w"]).collect():
        got.setdefault(r.w, set()).add(r.alert)
    assert got == {
        1: {"availability_below_99_percent", "cluster_less_than_3_nodes", "latency_p95_above_500ms", "error_rate_above_1_percent", "quota_usage_above_80_percent"},
        3: {"availability_below_99_percent", "latency_p95_above_1s", "error_rate_above_5_percent", "latency_p95_above_500ms", "error_rate_above_1_percent"}}


def test_gossip_sink_survives_batches_that_run_again(spark, tmp_path):
    from loomline.streaming import live

    path = str(tmp_path / "members")
    sink = live.merge_into(path, "id", "hb")
    batch = lambda rows: spark.createDataFrame(rows, "id long, hb long, seq long, v string")
    state = lambda: {r.id: r.v for r in live.members(spark, path).collect()}
    sink(batch([(1, 5, 1, "a"), (2, 5, 2, "b")]), 0)
    sink(batch([(1, 5, 1, "tie"), (2, 6, 2, "newer"), (3, 1, 3, "c")]), 1)
    want = {1: "a", 2: "newer", 3: "c"}
    assert state() == want
    sink(batch([(1, 5, 1, "tie"), (2, 6, 2, "newer"), (3, 1, 3, "c")]), 1)
    assert state() == want
    # A version that a crash left without its mark doesn't count.
    spark.range(1).write.parquet(f"{path}/v=2")
    (tmp_path / "members" / "v=2" / "_SUCCESS").unlink()
    assert state() == want
    sink(batch([(1, 9, 1, "z")]), 2)
    assert state() == want | {1: "z"}


def test_spreading_a_keys_weights_changes_nothing(spark):
    rnd = random.Random(7)
    rows = [(k, i, 0.0 if k == 1 else rnd.uniform(0, 9)) for k in (1, 2, 3, None) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, idx int, w double")
    for target in (100.0, 2.0**40, 2.0**-60):
        plain, spread = (sorted(map(tuple, t.normalize(df, "key", ["idx"], "w", target, s).select("key", "idx", F.round("normalized", 6), "status").collect()), key=str) for s in (False, True))
        assert plain == spread
        least = [sorted(((r.key, round(r.largest, 3)) for r in t.normalize_clamped_max(df, "key", "w", target, s).collect()), key=str) for s in (False, True)]
        assert least[0] == least[1]


@pytest.mark.parametrize("seed", range(3))
def test_parts_of_neighbours_ranks_and_rates(spark, seed):
    from loomline.operators import cluster as cl

    rnd = random.Random(seed)
    rows = [(k, i, rnd.randrange(0, 400) / 1.0, rnd.choice([1.0, 2.0, 3.0])) for k in range(3) for i in range(40)]
    rows = [(k, i, t, x) for (k, i, _, x), t in zip(rows, [t for k in range(3) for t in sorted(r[2] for r in rows if r[0] == k)], strict=True)]
    df = spark.createDataFrame(rows, "key long, seq long, at double, x double").withColumn("ts", F.timestamp_seconds("at"))
    plain = {r.key: tuple(r) for r in c.oscillation(df, "key", ["seq"], "x").collect()}
    assert {r.key: tuple(r) for r in c.oscillation(df, "key", ["seq"], "x", F.floor(F.col("seq") / 7)).collect()} == plain
    got = {(r.key, r.seq): r.admitted for r in cl.admit(df, "key", ["seq"], 5, F.floor(F.col("seq") / 3)).collect()}
    assert got == {(k, i): i < 5 for k, i, _, _ in rows}
    rates = {(r.key, r.seq): (r.n_recent, r.limited) for r in cl.over_rate(df, "key", "ts", 3).collect()}
    want = {(k, i): sum(k == q and t - 60 <= u <= t for q, _, u, _ in rows) for k, i, t, _ in rows}
    assert rates == {at: (n, n > 3) for at, n in want.items()}


def test_failed_jobs_are_planned_anew(spark):
    control = lc.Control(spark)
    tries = []

    def flaky(df):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return df

    job = control.submit([("flaky", flaky)], lc.JobConfig(max_retries=2))
    assert control.run(job, spark.range(4)).count() == 4 and control.status(job) == "completed" and len(tries) == 3
    names = [r.name for r in control.metrics().collect()]
    assert names.count("loomline_retries") == names.count("loomline_stage_errors") == 2
    tries.clear()
    job = control.submit([("flaky", flaky)], lc.JobConfig(max_retries=1))
    with pytest.raises(OSError, match="not yet"):
        control.run(job, spark.range(4))
    assert control.status(job) == "failed: not yet" and len(tries) == 2
