"""Metrics, service levels and run statistics over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.lifecycle import METRICS, PREFIX, Control, Quota, submit_graph
from loomline.operators import metrics as m
from loomline.operators.control import active_count
from loomline.plans.bindings import events
from loomline.session import table
from loomline.sources.tables import scratch

_ORDER = ["ts", "event_id"]


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.col("k"))
    return events(spark, sf_dir).withColumn("key", m.series_key(F.lit("events"), labels))


def counter_final(spark, sf_dir):
    return m.counter_totals(_keyed(spark, sf_dir), "key")


def counter_running(spark, sf_dir):
    return m.counter_log(events(spark, sf_dir).select("event_type", *_ORDER), "event_type", _ORDER, F.date_trunc("hour", "ts")).select("event_id",
        "event_type", "running")


def gauge_last(spark, sf_dir):
    return m.gauge_last(table(spark, sf_dir, "events"), "user_id", "value", _ORDER)


def prometheus_lines(spark, sf_dir):
    gauges = m.gauge_last(table(spark, sf_dir, "events").withColumn("key", F.concat(F.lit("last_event_type="), F.col("event_type"))), "key", "event_id", _ORDER)
    return m.exposition(counter_final(spark, sf_dir), gauges)


def _requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", *_ORDER, (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency"))


def sli_by_user(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy("user_id").agg(F.round(m.sli(F.col("success")), 9).alias("sli"))


def slo_met(spark, sf_dir):
    met = m.sli(F.col("success"))
    return _requests(spark, sf_dir).groupBy("user_id").agg((met >= 0.75).alias("met"))


def sli_of_nothing(spark, sf_dir):
    return _requests(spark, sf_dir).filter("user_id is null").agg(m.sli(F.col("success")).alias("sli"), F.coalesce(F.max("latency"), F.lit(0.0)).alias("p95"))


def p95_last1000(spark, sf_dir):
    return m.p95_recent(_requests(spark, sf_dir), ["event_type"], "latency", _ORDER)


def error_budget(spark, sf_dir):
    rows = spark.sql("select stack(3, 'availability', 0.999D, 'latency', 0.95D, 'error_rate', 0.01D) as (name, target)")
    return rows.select("name", "target", F.round(m.error_budget(F.col("target")), 6).alias("budget"))


def bench_stats(spark, sf_dir):
    s = m.run_statistics(table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sigma", "cv_percent", "low", "high", "p50", "p95", "p99")])


def _packets(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 8).alias("cpu"), F.length("props").cast("long").alias("bytes"), (F.col("event_type") == "error").alias("dropped"),
            F.floor("value").alias("latency_ns"))


def percpu_by_cpu(spark, sf_dir):
    return m.per_cpu(_packets(spark, sf_dir))


def percpu_snapshot(spark, sf_dir):
    return m.snapshot(percpu_by_cpu(spark, sf_dir))


def percpu_since_reset(spark, sf_dir):
    rows = _packets(spark, sf_dir).withColumn("epoch", F.lit(0))
    later = rows.filter("cpu >= 4").withColumn("epoch", F.lit(1))
    return m.per_cpu(m.since_reset(rows.unionByName(later)).drop("epoch"))


def alert_windows(spark, sf_dir):
    held = _requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = m.windowed_alerts(held, "ts", F.col("success"), "latency", "1 day", 0.85, 150.0, 0.2)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("availability", F.round("availability", 9))


def alert_windows_5m(spark, sf_dir):
    held = _requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = m.windowed_alerts(held, "ts", F.col("success"), "latency")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("availability", F.round("availability", 9))


#: The alert rules with thresholds that the events' latencies and error rates reach.
_RULES = tuple((name, column, window, sign, {1000.0: 150.0, 500.0: 110.0, 0.05: 0.2, 0.01: 0.1}.get(x, x), severity) for name, column, window, sign,
    x, severity in m.ALERTS)


def _naive(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _zoned(spark, sf_dir):
    return _requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def alerts_raised(spark, sf_dir):
    """All rules on availability, latency and errors by five minutes, as they stand."""
    out = m.raised(m.service_windows(_zoned(spark, sf_dir), "ts", F.col("success"), "latency"), ["window_start"])
    return _naive(out).withColumn("value", F.round("value", 9))


def alert_warnings(spark, sf_dir):
    """The warnings alone, by an hour, with thresholds that the events reach."""
    out = m.raised(m.service_windows(_zoned(spark, sf_dir), "ts", F.col("success"), "latency", "1 hour"), ["window_start"], "warning", _RULES)
    return _naive(out).withColumn("value", F.round("value", 9))


def healthy_nodes_2m(spark, sf_dir):
    """Users as nodes; whose last event in two minutes is an error is not healthy."""
    out = m.node_windows(_zoned(spark, sf_dir), "ts", "user_id", F.col("success"), _ORDER)
    alert = m.raised(out, ["window_start"]).select("window_start", "alert")
    return _naive(out.join(alert, "window_start", "left"))


def quota_usage_10m(spark, sf_dir):
    """Executions that signups begin and errors end, by kind of user, against the default quota."""
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = _zoned(spark, sf_dir).withColumns({"tenant": F.col("user_id") % 5, "change": change})
    active = active_count(rows, "tenant", _ORDER, "change", F.date_trunc("hour", "ts"))
    out = m.quota_windows(active, "ts", "tenant", F.col("active"), F.lit(float(Quota().max_concurrent)))
    alert = m.raised(out, ["window_start", "tenant"]).select("window_start", "tenant", "alert")
    return _naive(out.join(alert, ["window_start", "tenant"], "left")).withColumn("quota_usage", F.round("quota_usage", 9))


def rollback_triggers(spark, sf_dir):
    """Each user as a deployment; limits that the events reach."""
    out = m.rollbacks(_zoned(spark, sf_dir), ["user_id"], "ts", F.col("success"), "latency", _ORDER, 0.75, 0.2, 150.0, streak=1)
    return out.withColumns({c: F.round(c, 9) for c in ("error_rate", "budget_used")})


def bench_throughput(spark, sf_dir):
    """Rows and MB a second of runs of each type: values are times in ms, props the bytes."""
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.sum(F.length("props")).alias("bytes"))
    per_row, per_mb = m.throughput(F.col("mean"), F.col("n"), F.col("bytes"))
    return sums.select("event_type", F.round(per_row, 6).alias("rows_per_s"), F.round(per_mb, 9).alias("mb_per_s"))


def metric_names(spark, sf_dir):
    """What a job emits: names and kinds, from a run over a small table, with the counters' last values."""
    control = Control(spark)
    control.tenants.set("t", Quota())
    path = scratch(spark, "metrics")
    job = control.submit([("receptor", lambda d: d), ("terminal", lambda d: d.filter("r_regionkey < 3"))],
        submit_graph("t").with_config(output_path=path, required_nodes=2, max_execution_ms=None))
    control.run(job, table(spark, sf_dir, "region"))
    control.node_failed(control.nodes.own, job)
    try:
        control.run(control.submit([("broken", lambda d: d.select("nothing"))]), table(spark, sf_dir, "region"))
    except Exception:  # noqa: BLE001
        pass
    rows = control.metrics().withColumn("stage", F.coalesce(F.col("labels")["stage"], F.lit("")))
    known = F.when(F.col("name").endswith("stage_rows"), F.col("value").cast("long"))
    return rows.groupBy("name", "kind").agg(F.sum(known).alias("rows"))


def rate_1m(spark, sf_dir):
    out = m.rates(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.round("rate", 9).alias("rate"))


def failure_streaks(spark, sf_dir):
    out = m.longest_streak(table(spark, sf_dir, "events"), ["user_id"], _ORDER, F.col("event_type") == "error", F.date_trunc("day", "ts"))
    return out.withColumn("rollback", F.col("longest") > 3)


_BOUNDS = [10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 250.0]


def histogram_buckets(spark, sf_dir):
    return m.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", _BOUNDS[:-1])


def histogram_quantile_1d(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("window_start", F.window(F.col("ts").cast("timestamp"), "1 day")["start"].cast("timestamp_ntz"))
    out = m.histogram_quantile(m.histogram(rows, ["window_start"], "value", _BOUNDS), ["window_start"], 0.95)
    return out.withColumn("quantile", F.round("quantile", 6))


def stage_time_total(spark, sf_dir):
    times = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("ms"))
    maps = times.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ms"))).alias("stage_times_ms"))
    return maps.select("user_id", m.stage_total(F.col("stage_times_ms")).alias("total_ms"))


_KEY = "'events_k=' || json_extract_string(props, '$.k') || '_type=' || event_type"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY {v}) AS r, count(*) OVER (PARTITION BY {g}) AS n FROM {t}"
_PACKETS = "SELECT event_id % 8 AS cpu, length(props) AS bytes, event_type = 'error' AS dropped, CAST(floor(value) AS BIGINT) AS latency_ns FROM events"
_PER_CPU = (
    "SELECT cpu, count(*) AS packets, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS drops, CAST(sum(bytes) AS BIGINT) AS total_bytes, "
        "CAST(sum(latency_ns) AS BIGINT) AS latency, count(*) FILTER (WHERE latency_ns <> 0) AS latency_samples FROM ({t}) GROUP BY cpu")


def _alerts(bucket: str, availability: float, p95: float, errors: float) -> str:
    return (
        f"WITH w AS (SELECT {bucket} AS window_start, event_type <> 'error' AS ok, value FROM events), r AS ({_RANKED.format(g='window_start', v='value', t='w')}), "
        "s AS (SELECT window_start, count(*) AS n, avg(ok::DOUBLE) AS a, max(value) FILTER (WHERE r = least(floor(0.95 * n), n - 1) + 1) AS p95 FROM r GROUP BY 1) "
        f"SELECT window_start, n, round(a, 9) AS availability, p95, a < {availability} AS low_availability, p95 > {p95} AS slow, 1 - a > {errors} AS failing FROM s")


def _raised(windows: str, keys: str, rules) -> str:
    one = lambda name, column, _, sign, x, severity: f"SELECT {keys}, '{name}' AS alert, '{severity}' AS severity, {column}::DOUBLE AS value FROM s WHERE {column} {sign} {x}"
    return windows + " UNION ALL ".join(one(*r) for r in rules)


def _service(bucket: str) -> str:
    return (
        f"WITH w AS (SELECT {bucket} AS window_start, event_type <> 'error' AS ok, value FROM events), r AS ({_RANKED.format(g='window_start', v='value', t='w')}), "
        "s AS (SELECT window_start, round(avg(ok::DOUBLE), 9) AS availability, round(1 - avg(ok::DOUBLE), 9) AS error_rate, round(max(value) FILTER "
            "(WHERE r = least(floor(0.95 * n), n - 1) + 1), 9) AS p95 FROM r GROUP BY 1) ")


_ON = ("availability", "p95", "error_rate")
_ACTIVE = (
    "d AS (SELECT ts, event_id, user_id % 5 AS tenant, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS x FROM events), c AS "
        "(SELECT *, sum(x) OVER w AS s FROM d WINDOW w AS (PARTITION BY tenant ORDER BY ts, event_id)), a AS (SELECT *, s - least(0, min(s) OVER "
        "(PARTITION BY tenant ORDER BY ts, event_id)) AS active FROM c)")
QUERIES = {f.__name__: f for f in (
    alerts_raised, alert_warnings, healthy_nodes_2m, quota_usage_10m, rollback_triggers, bench_throughput, metric_names,
    counter_final, counter_running, gauge_last, prometheus_lines, sli_by_user, slo_met, sli_of_nothing, p95_last1000, error_budget, bench_stats,
        percpu_by_cpu, percpu_snapshot,
    percpu_since_reset, alert_windows, alert_windows_5m, rate_1m, failure_streaks, histogram_buckets, histogram_quantile_1d, stage_time_total)}
ORACLES = {
    "alerts_raised": _raised(_service("time_bucket(INTERVAL '5 minutes', ts)"), "window_start", [r for r in m.ALERTS if r[1] in _ON]),
    "alert_warnings": _raised(_service("date_trunc('hour', ts)"), "window_start", [r for r in _RULES if r[1] in _ON and r[5] == "warning"]),
    "healthy_nodes_2m": "WITH l AS (SELECT time_bucket(INTERVAL '2 minutes', ts) AS window_start, user_id, arg_max(event_type <> 'error', (ts, "
        "event_id)) AS ok FROM events GROUP BY 1, 2), s AS (SELECT window_start, count(*) FILTER (WHERE ok) AS healthy_nodes FROM l GROUP BY 1) "
        "SELECT *, CASE WHEN healthy_nodes < 3 THEN 'cluster_less_than_3_nodes' END AS alert FROM s",
    "quota_usage_10m": f"WITH {_ACTIVE}, s AS (SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, tenant, max(active) / 10.0::DOUBLE AS "
        f"quota_usage FROM a GROUP BY 1, 2) SELECT window_start, tenant, round(quota_usage, 9) AS quota_usage, CASE WHEN quota_usage > 0.8 THEN "
        f"'quota_usage_above_80_percent' END AS alert FROM s",
    "rollback_triggers": f"WITH e AS (SELECT *, time_bucket(INTERVAL '2 minutes', ts) AS b, event_type = 'error' AS f FROM events), t AS (SELECT "
        f"user_id, 1 - avg((NOT f)::DOUBLE) AS error_rate FROM e GROUP BY 1), r AS ({_RANKED.format(g='user_id, b', v='value', t='e')}), "
    "w AS (SELECT user_id, b, max(value) FILTER (WHERE r = least(floor(0.95 * n), n - 1) + 1) AS p95 FROM r GROUP BY 1, 2), x AS (SELECT user_id, "
        "count(*) FILTER (WHERE p95 > 150) AS slow_windows FROM w GROUP BY 1), "
    "i AS (SELECT user_id, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e), y AS (SELECT "
        "user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) FILTER (WHERE f) AS n FROM i GROUP BY 1, 2) GROUP BY 1) "
    "SELECT user_id, round(error_rate, 9) AS error_rate, slow_windows, longest, round(error_rate / 0.25::DOUBLE, 9) AS budget_used, error_rate > 0.2 "
        "AS failing, slow_windows > 0 AS slow, longest > 1 AS unhealthy, error_rate / 0.25::DOUBLE >= 1 AS exhausted FROM t JOIN x USING (user_id) "
        "JOIN y USING (user_id)",
    "bench_throughput": "SELECT event_type, round(count(*) / (avg(value) / 1000), 6) AS rows_per_s, round(sum(length(props)) / 1048576.0::DOUBLE / "
        "(avg(value) / 1000), 9) AS mb_per_s FROM events GROUP BY 1",
    "metric_names": "SELECT name, kind, CASE WHEN name LIKE '%stage_rows' THEN 8 END::BIGINT "
        "AS rows FROM (VALUES " + ", ".join(f"('{PREFIX}{n}', '{k}')" for n, k in METRICS.items()) + ") t(name, kind)",
    "counter_final": f"SELECT {_KEY} AS key, count(*) AS total FROM events GROUP BY 1",
    "counter_running": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS running FROM events",
    "gauge_last": "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
    "prometheus_lines": f"SELECT 0 AS part, {_KEY} || ' ' || count(*) AS line FROM events GROUP BY {_KEY} UNION ALL SELECT 1, 'last_event_type=' || "
        f"event_type || ' ' || arg_max(event_id, (ts, event_id)) FROM events GROUP BY event_type",
    "sli_by_user": "SELECT user_id, round(coalesce(avg((event_type <> 'error')::DOUBLE), 1.0), 9) AS sli FROM events GROUP BY 1",
    "slo_met": "SELECT user_id, coalesce(avg((event_type <> 'error')::DOUBLE), 1.0) >= 0.75 AS met FROM events GROUP BY 1",
    "sli_of_nothing": "SELECT 1.0::DOUBLE AS sli, 0.0::DOUBLE AS p95",
    "p95_last1000": f"WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS q FROM "
        f"events) WHERE q <= 1000), r AS ({_RANKED.format(g='event_type', v='value', t='t')}) SELECT event_type, max(value) AS p95 FROM r WHERE r = "
        f"least(floor(0.95 * n), n - 1) + 1 GROUP BY 1",
    "error_budget": "SELECT name, target::DOUBLE AS target, round((1 - target::DOUBLE) * 100, 6) AS budget FROM (VALUES ('availability', 0.999), "
        "('latency', 0.95), ('error_rate', 0.01)) t(name, target)",
    "bench_stats": f"WITH r AS ({_RANKED.format(g='event_type', v='value', t='events')}), s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, "
        f"sqrt(var_pop(value)) AS sigma, min(value) AS low, max(value) AS high, max(value) FILTER (WHERE r = least(floor(0.5 * n), n - 1) + 1) AS "
        f"p50, max(value) FILTER (WHERE r = least(floor(0.95 * n), n - 1) + 1) AS p95, max(value) FILTER (WHERE r = least(floor(0.99 * n), n - 1) + "
        f"1) AS p99 FROM r GROUP BY 1) "
    "SELECT event_type, n, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round(CASE WHEN mean > 0 THEN sigma / mean * 100 ELSE 0 END, 6) AS "
        "cv_percent, round(low, 6) AS low, round(high, 6) AS high, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM s",
    "percpu_by_cpu": _PER_CPU.format(t=_PACKETS),
    "percpu_snapshot": f"SELECT count(*) AS cpu_count, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(drops) AS BIGINT) AS drops, "
        f"CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(latency) AS BIGINT) AS latency, CAST(sum(latency_samples) AS BIGINT) AS "
        f"latency_samples FROM ({_PER_CPU.format(t=_PACKETS)})",
    "percpu_since_reset": _PER_CPU.format(t=_PACKETS + " WHERE event_id % 8 >= 4"),
    "alert_windows": _alerts("date_trunc('day', ts)", 0.85, 150.0, 0.2),
    "alert_windows_5m": _alerts("time_bucket(INTERVAL '5 minutes', ts)", 0.99, 1000.0, 0.05),
    "rate_1m": "SELECT event_type, date_trunc('minute', ts) AS window_start, round(count(*) / 60.0::DOUBLE, 9) AS rate FROM events GROUP BY 1, 2",
    "failure_streaks": "WITH i AS (SELECT user_id, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION "
        "BY user_id ORDER BY ts, event_id) AS g FROM events), s AS (SELECT user_id, g, count(*) FILTER (WHERE f) AS n FROM i GROUP BY 1, 2) SELECT "
        "user_id, max(n) AS longest, max(n) > 3 AS rollback FROM s GROUP BY 1",
    "histogram_buckets": "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, (VALUES (10.0::DOUBLE), (25.0), (50.0), "
        "(75.0), (100.0), (150.0), ('inf'::DOUBLE)) b(le) GROUP BY 1, 2",
    "histogram_quantile_1d": "WITH b AS (SELECT date_trunc('day', ts) AS window_start, le, count(*) FILTER (WHERE value <= le) AS n FROM events, "
        "(VALUES (10.0::DOUBLE), (25.0), (50.0), (75.0), (100.0), (150.0), (250.0), ('inf'::DOUBLE)) b(le) GROUP BY 1, 2), c AS (SELECT *, "
        "coalesce(lag(n) OVER w, 0) AS m, coalesce(lag(le) OVER w, 0) AS low, 0.95::DOUBLE * max(n) OVER (PARTITION BY window_start) AS r FROM b "
        "WINDOW w AS (PARTITION BY window_start ORDER BY le)) SELECT window_start, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (r - m) "
        "/ (n - m) END, 6) AS quantile FROM c WHERE n >= r AND m < r",
    "stage_time_total": "SELECT user_id, count(*) AS total_ms FROM events GROUP BY 1",
}
