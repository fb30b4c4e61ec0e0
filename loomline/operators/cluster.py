"""Cluster state as data: last-writer-wins merges, membership, routes, allocation and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.metrics import counter_log


def alive(status: str = "status") -> Column:
    return F.col(status) == "Connected"


def gossip_merge(rows: DataFrame, key: str, heartbeat: str, seq: str) -> DataFrame:
    """The row with the latest heartbeat of each key; among equals the first to arrive stays. An aggregate, so that a
    key with very many rows is combined before it is exchanged."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(heartbeat), -F.col(seq))).alias("s"))
    return best.select(key, "s.*")


def convergence(status: Column) -> Column:
    """The share of members alive, this one included; 1.0 of none."""
    return F.coalesce(F.avg(status.cast("double")), F.lit(1.0))


def last_event(rows: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(kind, F.struct(*order)).alias(kind))


def heartbeats(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last heartbeat of each key, and its incarnation: one more with every heartbeat."""
    return rows.groupBy(key).agg(F.max(ts).alias("last_heartbeat"), F.count(F.lit(1)).alias("incarnation"))


def next_hops(targets: DataFrame, routes: DataFrame) -> DataFrame:
    """(target) against routes(target, next_hop, distance): direct targets are their own hop; unknown ones have none."""
    hop = F.when(F.col("distance") == 1, F.col("target")).otherwise(F.col("next_hop"))
    return targets.join(routes, "target", "left").select("target", hop.alias("hop"), "distance")


def route_table(changes: DataFrame, order: list[str]) -> DataFrame:
    """(target, next_hop, distance, address) added in order -> the last route of each target. A peer is a route without
    a next hop at distance 1."""
    return registry(changes, "target", order).select("target", "next_hop", "distance", "address")


def peers(changes: DataFrame, order: list[str]) -> DataFrame:
    """Peers as often as they were added, in order: (position from 1, target). Routes by way of others are none."""
    own = changes.filter(F.col("next_hop").isNull() & (F.col("distance") == 1))
    return own.select((F.row_number().over(Window.orderBy(*order))).alias("position"), "target")  # a node's own list


def update_routes(routes: DataFrame, members: DataFrame, own: Column) -> DataFrame:
    """Every member but this one becomes a direct route, in place of any route that was there."""
    direct = members.filter(F.col("target") != own).select("target").distinct()
    old = routes.join(direct, "target", "left_anti").select("target", "next_hop", "distance")
    return old.unionByName(direct.select("target", F.lit(None).cast(routes.schema["next_hop"].dataType).alias("next_hop"), F.lit(1).alias("distance")))


def allocate(nodes: DataFrame, n: int, key: str = "id", state: str = "state") -> DataFrame:
    """The first n ready nodes by key; fewer, or none, where there aren't so many."""
    return nodes.filter(F.col(state) == "Ready").orderBy(key).limit(n)


def admit(submissions: DataFrame, tenant: str, order: list[str], most: Column | int, part: Column | None = None) -> DataFrame:
    """Submissions in order until a tenant has as many active as it may; a tenant without quota (null) is admitted. part:
    something that never falls in that order, like the month, by which a tenant with very many submissions is spread."""
    ranked = counter_log(submissions, tenant, order, part)
    limit = F.lit(most) if isinstance(most, int) else most
    return ranked.withColumn("admitted", F.coalesce(F.col("running") <= limit, F.lit(True))).drop("running")


def idempotent(submissions: DataFrame, key: str, graph: str, order: list[str]) -> DataFrame:
    """Every submission with the graph that it gets: its key's first one; without a key its own."""
    first = submissions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(graph, F.struct(*order)).alias("_first"))
    return submissions.join(first, key, "left").withColumn("effective", F.coalesce("_first", graph)).drop("_first")


def over_rate(rows: DataFrame, tenant: str, ts: str, cap: int, seconds: int = 60) -> DataFrame:
    """Submissions with the number of their tenant's in the seconds up to them, and whether that is over the cap. Time is
    cut into parts of so many seconds; rows are counted with those of their own part and the one before, so that a
    tenant with very many is spread."""
    span = seconds * 1_000_000
    held = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.floor(F.col("_at") / span)
    seen = held.withColumn("_later", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_part", own + F.col("_later").cast("int"))
    w = Window.partitionBy(tenant, "_part").orderBy("_at").rangeBetween(-span, 0)
    out = seen.withColumn("n_recent", F.count(F.lit(1)).over(w)).filter(~F.col("_later")).drop("_at", "_later", "_part")
    return out.withColumn("limited", F.col("n_recent") > cap)


def combine(*inputs: DataFrame) -> DataFrame:
    """The aggregation stage's inputs as one table, columns by name."""
    out = inputs[0]
    for x in inputs[1:]:
        out = out.unionByName(x)
    return out


def replay_states(known: DataFrame, events: DataFrame, key: str, state: str, order: list[str], default: str = "Ready") -> DataFrame:
    """The last state of each known node; events of unknown nodes change nothing, nodes without events keep the default."""
    last = last_event(events, key, state, order)
    return known.select(key).distinct().join(last, key, "left").select(key, F.coalesce(state, F.lit(default)).alias(state))


def registry(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keyed upserts: the last row written of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")
