"""Cluster state, routes, admission and protocol predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.errors import JobError
from loomline.functions import protocol as p
from loomline.lifecycle import Capacity, Control, Credentials, Quota, submit_graph
from loomline.operators import cluster as c
from loomline.session import table


def _beats(spark, sf_dir):
    """Members as users; heartbeats of one hour are ties; errors fail a member."""
    status = F.when(F.col("event_type") == "error", "Failed").otherwise("Connected")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("heartbeat"),
        F.col("event_id").alias("seq"), status.alias("status"))


def gossip_merge(spark, sf_dir):
    return c.gossip_merge(_beats(spark, sf_dir), "id", "heartbeat", "seq")


def alive_members(spark, sf_dir):
    return gossip_merge(spark, sf_dir).filter(c.alive() & (F.col("id") != 1)).select("id")


def convergence(spark, sf_dir):
    return gossip_merge(spark, sf_dir).agg(F.round(c.convergence(c.alive()), 9).alias("convergence"))


def membership_last(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "Failure").when(F.col("event_type") == "signup", "Join").when(F.col("event_type") == "view", "Rejoin")
    rows = table(spark, sf_dir, "events").select("user_id", kind.alias("kind"), "ts", "event_id").filter("kind is not null")
    return c.last_event(rows, "user_id", "kind", ["ts", "event_id"])


def heartbeat_incarnation(spark, sf_dir):
    return c.heartbeats(table(spark, sf_dir, "events").filter("event_type = 'click'"), "user_id", "ts")


def _routes(spark, sf_dir):
    """Nations as targets: direct in region 0, else by way of the nation that stands for the region."""
    nation = table(spark, sf_dir, "nation")
    hop = F.concat(F.lit("region-"), F.col("n_regionkey"))
    direct = F.col("n_regionkey") == 0
    return nation.select(F.concat(F.lit("nation-"), F.col("n_nationkey")).alias("target"), F.when(~direct, hop).alias("next_hop"),
        F.when(direct, 1).otherwise(2).alias("distance"))


def route_next_hop(spark, sf_dir):
    targets = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation-"), F.col("c_nationkey") + 5).alias("target")).distinct()
    return c.next_hops(targets, _routes(spark, sf_dir))


def routes_after_update(spark, sf_dir):
    members = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nation-"), F.col("s_nationkey") * 2).alias("target"))
    return c.update_routes(_routes(spark, sf_dir), members, F.lit("nation-0"))


def allocate_nodes(spark, sf_dir):
    state = F.when(F.col("s_acctbal") > 0, "Ready").otherwise("Failed")
    return c.allocate(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), state.alias("state")), 7)


def ready_nodes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))


def quota_admission(spark, sf_dir):
    quotas = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"),
        (F.col("c_custkey") % 4 + 1).cast("int").alias("most"))
    rows = table(spark, sf_dir, "orders").join(quotas, "o_custkey", "left")
    return c.admit(rows, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("most"), F.date_trunc("month", "o_orderdate")).select("o_orderkey", "o_custkey", "admitted")


def unknown_tenants(spark, sf_dir):
    quotas = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(quotas, "o_custkey", "left_anti").select("o_custkey").distinct()


def idempotent_submit(spark, sf_dir):
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.concat_ws("-", "o_custkey", "o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", key.alias("key"))
    return c.idempotent(rows, "key", "o_orderkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "effective")


def rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return c.over_rate(rows, "user_id", "ts", 2, 86400).select("event_id", "n_recent", "limited")


def aggregation_union(spark, sf_dir):
    parts = [table(spark, sf_dir, n).select(F.col(f"{a}_nationkey").alias("nationkey"), F.col(f"{a}_acctbal").alias("acctbal")) for n,
        a in (("customer", "c"), ("supplier", "s"))]
    return c.combine(*parts).groupBy("nationkey").agg(F.round(F.sum("acctbal"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def node_states(spark, sf_dir):
    """Customers as nodes; errors fail them, signups bring them back."""
    kind = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "signup", "Ready").when(F.col("event_type") == "purchase", "Executing")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), kind.alias("state"), "ts", "event_id").filter("state is not null")
    return c.replay_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), events, "id", "state", ["ts", "event_id"])


def tenant_quotas(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tenant"), "o_orderdate", "o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("max_concurrent"))
    return c.registry(rows, "tenant", ["o_orderdate", "o_orderkey"]).select("tenant", "max_concurrent")


#: Kinds of events as kinds of messages; errors stay what they are, which no kind of message is.
_KINDS = {"click": "Heartbeat", "view": "Gossip", "signup": "Join", "purchase": "StageComplete"}


def _messages(spark, sf_dir):
    """Events as messages of the version that their label names, to the node of another label."""
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    v = F.struct((F.col("event_id") % 3).cast("int").alias("major"), F.lit(1).alias("minor"), F.lit(0).alias("patch"))
    at = F.date_trunc("second", "ts").cast("timestamp")
    target = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("node-"), F.col("event_id") % 7))
    message = p.envelope(F.concat(F.lit("m-"), F.col("event_id")), kind, F.col("props"), F.col("user_id").cast("string"), at, target, v)
    return table(spark, sf_dir, "events").select("event_id", message.alias("message"))


def envelope_roundtrip(spark, sf_dir):
    rows = _messages(spark, sf_dir).select("event_id", p.opened(F.col("message")).alias("m"))
    return rows.select(
        "event_id", "m.id", "m.message_type", p.version_text(F.col("m.version")).alias("version"), "m.source", "m.target",
            F.col("m.timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.get_json_object("m.payload", "$.k").alias("k"))


def message_errors(spark, sf_dir):
    """Every tenth message is cut short; kinds that there are none of and versions that nobody supports are refused."""
    text = F.when(F.col("event_id") % 10 == 9, F.lit("{broken")).otherwise(F.col("message"))
    supported = F.array(p.version(1, 0, 0), p.version(2, 0, 0))
    return _messages(spark, sf_dir).select("event_id", p.message_error(text, supported).alias("error"))


def message_kinds(spark, sf_dir):
    kinds = spark.createDataFrame([(k,) for k in (*p.MESSAGES, "Submit", "Negotiate")], "kind string")
    return kinds.select("kind", p.kind_error(F.col("kind")).alias("error"))


def _route_changes(spark, sf_dir):
    """Suppliers in order: those of even nations are added as peers, others as routes by way of the region's node."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    rows = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    peer = F.col("s_nationkey") % 2 == 0
    return rows.select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit("node-"), F.col("s_nationkey") % 6).alias("target"),
            F.when(~peer, F.concat(F.lit("node-r"), F.col("n_regionkey"))).alias("next_hop"),
        F.when(peer, 1).otherwise(2).alias("distance"), F.concat(F.lit("10.0.0."), F.col("s_nationkey")).alias("address"))


def route_registry(spark, sf_dir):
    return c.route_table(_route_changes(spark, sf_dir), ["seq"])


def peer_list(spark, sf_dir):
    return c.peers(_route_changes(spark, sf_dir), ["seq"])


def node_capacity(spark, sf_dir):
    """Ready nodes' capacity: what is registered without figures has the defaults."""
    own = Capacity()
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") > 0, "Ready").otherwise("Failed").alias("state"),
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 8 + 1).alias("cores"))
    held = rows.select("state", F.lit(own.max_concurrent).alias("max_concurrent"), F.lit(own.memory_mb).alias("memory_mb"),
        F.coalesce("cores", F.lit(own.cpu_cores)).alias("cores"))
    return held.groupBy("state").agg(F.count(F.lit(1)).alias("nodes"), *[F.sum(x).cast("long").alias(x) for x in ("max_concurrent", "memory_mb", "cores")])


def job_lifecycle(spark, sf_dir):
    """What a control plane of its own answers, step by step: admission, one job of a key, states, cancelling, quotas."""
    control = Control(spark, require_credentials=True)
    control.tenants.set("t", Quota(max_concurrent=2, max_memory_mb=2000))
    config = submit_graph("t").with_config(credentials=Credentials(token="x"))
    steps: list[tuple[int, str, str]] = []

    def step(name, call):
        try:
            found = call()
        except JobError as e:
            found = str(e)
        steps.append((len(steps), name, str(found)))
        return found

    stages = [("receptor", lambda d: d), ("aggregation", lambda d: d.groupBy("r_regionkey").count())]
    step("no credentials", lambda: control.submit(stages, submit_graph("t")))
    first = control.submit(stages, config.with_idempotency_key("k"))
    step("same key", lambda: control.submit(stages, config.with_idempotency_key("k")) == first)
    step("another tenant's key", lambda: control.submit(stages, config.with_config(tenant="u", idempotency_key="k")) == first)
    step("pending", lambda: control.status(first))
    step("nodes", lambda: len(control.allocation(first).nodes))
    step("cancel pending", lambda: control.cancel(first))
    step("too much memory", lambda: control.submit(stages, config.with_config(memory_mb=1500)))
    step("too much fuel", lambda: control.submit(stages, config.with_config(max_fuel=2_000_000)))
    second = control.submit(stages, config)
    step("too many", lambda: control.submit(stages, config))
    step("abort", lambda: control.abort(second) or control.status(second))
    step("rows", lambda: control.run(first, table(spark, sf_dir, "region")).count())
    step("done", lambda: control.status(first))
    step("run again", lambda: control.run(first, table(spark, sf_dir, "region")))
    step("unknown", lambda: control.status("none"))
    step("listed", lambda: len(control.list()))
    return spark.createDataFrame(steps, "step int, name string, answer string")


_VERSIONS = ((1, 0, 0), (1, 1, 0), (1, 1, 5), (2, 0, 0), (0, 9, 9))


def version_matrix(spark, sf_dir):
    rows = spark.createDataFrame(_VERSIONS, "major int, minor int, patch int")
    x, y = (rows.select(F.struct("major", "minor", "patch").alias(n)) for n in "xy")
    both = x.join(y)  # a few literal rows
    held = F.array(*[F.struct(F.lit(x).alias("major"), F.lit(y).alias("minor"), F.lit(z).alias("patch")) for x, y, z in ((1, 0, 0), (2, 0, 0))])
    return both.select(p.version_text(F.col("x")).alias("a"), p.version_text(F.col("y")).alias("b"),
        p.compatible(F.col("x"), F.col("y")).alias("compatible"), p.newer(F.col("x"), F.col("y")).alias("newer"),
                       p.supported(F.col("x"), held).alias("supported"), p.supported_text(held).alias("supported_text"))


def version_errors(spark, sf_dir):
    rows = spark.createDataFrame(_VERSIONS, "major int, minor int, patch int").select(F.struct("major", "minor", "patch").alias("v"))
    return rows.select(p.version_text(F.col("v")).alias("version"), p.version_error(F.col("v"), F.array(p.version(1, 0, 0), p.version(3, 2, 1))).alias("error"))


def deprecation_state(spark, sf_dir):
    now = F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")
    at, days = F.col("o_orderdate"), (F.col("o_orderkey") % 900).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.is_deprecated(at, now).alias("deprecated"),
        p.is_removed(at, days, now).alias("removed"), p.key_valid(at, days, now).alias("key_valid"))


def graph_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "Failed").when(F.col("o_orderstatus") == "O", "Running").otherwise("Completed")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("s"), "o_orderpriority")
    return rows.select("o_orderkey", p.status_text(F.col("s"), F.col("o_orderpriority")).alias("status"),
        p.is_terminal(F.col("s")).alias("terminal"), p.is_active(F.col("s")).alias("active"))


_G = (
    "g AS (SELECT user_id AS id, arg_max({'h': date_trunc('day', ts), 's': event_id, "
    "'st': CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Connected' END}, (date_trunc('day', ts), -event_id)) AS x FROM events GROUP BY 1)")
_R = (
    "routes AS (SELECT 'nation-' || n_nationkey AS target, CASE WHEN n_regionkey <> 0 THEN 'region-' || n_regionkey END AS next_hop, CASE WHEN "
        "n_regionkey = 0 THEN 1 ELSE 2 END AS distance FROM nation)")
_V = "(VALUES " + ", ".join(map(str, _VERSIONS)) + ")"
_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items()) + " ELSE event_type END"
_CHANGES = (
    "WITH r AS (SELECT s_suppkey AS seq, 'node-' || (s_nationkey % 6) AS target, CASE WHEN s_nationkey % 2 <> 0 THEN 'node-r' || n_regionkey END AS "
        "next_hop, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END AS distance, '10.0.0.' || s_nationkey AS address FROM supplier JOIN nation ON "
        "s_nationkey = n_nationkey)")
QUERIES = {f.__name__: f for f in (
    gossip_merge, alive_members, convergence, membership_last, heartbeat_incarnation, route_next_hop, routes_after_update, allocate_nodes,
        ready_nodes, quota_admission, unknown_tenants,
    idempotent_submit, rate_limit, aggregation_union, version_matrix, deprecation_state, graph_status, node_states, tenant_quotas, envelope_roundtrip,
    message_errors, message_kinds, version_errors, route_registry, peer_list, node_capacity, job_lifecycle)}
ORACLES = {
    "gossip_merge": f"WITH {_G} SELECT id, x.h AS heartbeat, x.s AS seq, x.st AS status FROM g",
    "alive_members": f"WITH {_G} SELECT id FROM g WHERE x.st = 'Connected' AND id <> 1",
    "convergence": f"WITH {_G} SELECT round(coalesce(avg((x.st = 'Connected')::DOUBLE), 1.0), 9) AS convergence FROM g",
    "membership_last": "SELECT user_id, arg_max(CASE event_type WHEN 'error' THEN 'Failure' WHEN 'signup' THEN 'Join' ELSE 'Rejoin' END, (ts, "
        "event_id)) AS kind FROM events WHERE event_type IN ('error', 'signup', 'view') GROUP BY 1",
    "heartbeat_incarnation": "SELECT user_id, max(ts) AS last_heartbeat, count(*) AS incarnation FROM events WHERE event_type = 'click' GROUP BY 1",
    "route_next_hop": f"WITH {_R} SELECT t.target, CASE WHEN distance = 1 THEN t.target ELSE next_hop END AS hop, distance FROM (SELECT DISTINCT "
        f"'nation-' || (c_nationkey + 5) AS target FROM customer) t LEFT JOIN routes r ON t.target = r.target",
    "routes_after_update": f"WITH {_R}, m AS (SELECT DISTINCT 'nation-' || (s_nationkey * 2) AS target FROM supplier), d AS (SELECT target FROM m "
        f"WHERE target <> 'nation-0') SELECT * FROM routes WHERE target NOT IN (SELECT target FROM d) UNION ALL SELECT target, NULL, 1 FROM d",
    "allocate_nodes": "SELECT s_suppkey AS id, 'Ready' AS state FROM supplier WHERE s_acctbal > 0 ORDER BY 1 LIMIT 7",
    "ready_nodes": "SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0",
    "quota_admission": "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 <> 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey) "
        "THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= o_custkey % 4 + 1 ELSE true END AS admitted FROM orders",
    "unknown_tenants": "SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 5 <> 0)",
    "idempotent_submit": "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey ELSE first_value(o_orderkey) OVER (PARTITION BY "
        "o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) END AS effective FROM orders",
    "rate_limit": "SELECT event_id, count(*) OVER w AS n_recent, count(*) OVER w > 2 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER "
        "BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)",
    "aggregation_union": "SELECT nationkey, round(sum(acctbal), 4) AS total, count(*) AS n FROM (SELECT c_nationkey AS nationkey, c_acctbal AS "
        "acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) GROUP BY 1",
    "version_matrix": f"SELECT a.x || '.' || a.y || '.' || a.z AS a, b.x || '.' || b.y || '.' || b.z AS b, a.x = b.x AS compatible, (a.x, a.y, a.z) > "
        f"(b.x, b.y, b.z) AS newer, a.x IN (1, 2) AS supported, '1.0.0, 2.0.0' AS supported_text FROM {_V} a(x, y, z), {_V} b(x, y, z)",
    "deprecation_state": "SELECT o_orderkey, TIMESTAMP '1997-06-01' >= o_orderdate AS deprecated, TIMESTAMP '1997-06-01' >= o_orderdate + "
        "to_days((o_orderkey % 900)::INT) AS removed, TIMESTAMP '1997-06-01' < o_orderdate + to_hours((o_orderkey % 900)::INT) AS "
        "key_valid FROM orders",
    "node_states": "WITH l AS (SELECT user_id AS id, arg_max(CASE event_type WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Ready' ELSE 'Executing' "
        "END, (ts, event_id)) AS state FROM events WHERE event_type IN ('error', 'signup', 'purchase') GROUP BY 1) SELECT c_custkey AS id, "
        "coalesce(state, 'Ready') AS state FROM customer LEFT JOIN l ON c_custkey = id",
    "tenant_quotas": "SELECT o_custkey AS tenant, arg_max(o_orderkey % 7 + 1, (o_orderdate, o_orderkey)) AS max_concurrent FROM orders GROUP BY 1",
    "envelope_roundtrip": f"SELECT event_id, 'm-' || event_id AS id, {_KIND} AS message_type, (event_id % 3) || '.1.0' AS version, user_id::VARCHAR "
        f"AS source, CASE WHEN event_id % 2 = 0 THEN 'node-' || (event_id % 7) END AS target, date_trunc('second', ts) AS timestamp, "
        f"json_extract_string(props, '$.k') AS k FROM events",
    "message_errors": "SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'Invalid message: {broken' WHEN event_type = 'error' THEN 'Unsupported "
        "message type: error' WHEN event_id % 3 = 0 THEN 'Protocol version mismatch: expected one of 1.0.0, 2.0.0, got 0.1.0' "
        "END AS error FROM events",
    "message_kinds": "SELECT kind, CASE WHEN kind IN ('Submit', 'Negotiate') THEN 'Unsupported message type: ' || kind END AS error FROM (VALUES "
        "('SubmitGraph'), ('GetStatus'), ('CancelExecution'), ('AllocateNodes'), ('Gossip'), ('Heartbeat'), ('Join'), ('Leave'), ('Failure'), "
        "('ExecuteStage'), ('StageComplete'), ('DataTransfer'), ('Submit'), ('Negotiate')) t(kind)",
    "version_errors": f"SELECT x || '.' || y || '.' || z AS version, CASE WHEN x NOT IN (1, 3) THEN 'Protocol version mismatch: expected one of "
        f"1.0.0, 3.2.1, got ' || x || '.' || y || '.' || z END AS error FROM {_V} v(x, y, z)",
    "route_registry": f"{_CHANGES} SELECT target, nullif(arg_max(coalesce(next_hop, ''), seq), '') AS next_hop, arg_max(distance, seq) AS distance, "
        f"arg_max(address, seq) AS address FROM r GROUP BY 1",
    "peer_list": f"{_CHANGES} SELECT CAST(row_number() OVER (ORDER BY seq) AS INT) AS position, target FROM r WHERE next_hop IS NULL AND distance = 1",
    "node_capacity": "SELECT CASE WHEN s_acctbal > 0 THEN 'Ready' ELSE 'Failed' END AS state, count(*) AS nodes, 4 * count(*) AS max_concurrent, 2048 "
        "* count(*) AS memory_mb, CAST(sum(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 8 + 1 ELSE 4 END) AS BIGINT) AS cores "
        "FROM supplier GROUP BY 1",
    "job_lifecycle": "SELECT * FROM (VALUES (0, 'no credentials', 'Authentication required'), (1, 'same key', 'True'), (2, 'another tenant''s key', "
        "'False'), (3, 'pending', 'pending'), (4, 'nodes', '1'), (5, 'cancel pending', 'Graph not in valid state for operation: "
        "Graph is not running'), "
    "(6, 'too much memory', 'Resource quota exceeded: Tenant t has reached maximum memory'), (7, 'too much fuel', 'Resource quota exceeded: Tenant t "
        "has reached maximum fuel'), (8, 'too many', 'Resource quota exceeded: Tenant t has reached maximum concurrent graphs'), (9, 'abort', "
        "'cancelled'), (10, 'rows', '5'), "
    "(11, 'done', 'completed'), (12, 'run again', 'Graph not in valid state for operation: Completed cannot become Running'), (13, 'unknown', 'Graph "
        "not found: none'), (14, 'listed', '3')) t(step, name, answer)",
    "graph_status": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'failed: ' || o_orderpriority WHEN 'O' THEN 'running' ELSE 'completed' END "
        "AS status, o_orderstatus <> 'O' AS terminal, o_orderstatus = 'O' AS active FROM orders",
}
