"""Control series and tensor weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import control as c
from loomline.operators import metrics as m
from loomline.operators import tensor as t
from loomline.plans.bindings import deltas
from loomline.session import table

_ORDER = ["ts", "event_id"]


def _values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", *_ORDER, "value")


def eps_variance(spark, sf_dir):
    kept = m.recent(_values(spark, sf_dir), ["user_id"], _ORDER, 20)
    return kept.groupBy("user_id").agg(F.round(c.series_variance("value"), 6).alias("variance"), F.count(F.lit(1)).alias("n"))


def eps_oscillation(spark, sf_dir):
    return c.oscillation(_values(spark, sf_dir), "user_id", _ORDER, "value", F.date_trunc("day", "ts"))


def warmup_first_convergence(spark, sf_dir):
    return c.warmup(_values(spark, sf_dir), "user_id", _ORDER, "value", 700.0)


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(x, 8).alias(x) for x in ("integral", "error", "epsilon")])


def pid_final(spark, sf_dir):
    return _rounded(c.pid_final(deltas(spark, sf_dir), "user_id", _ORDER, "delta"), "user_id")


def pid_trace(spark, sf_dir):
    return _rounded(c.pid_trace(deltas(spark, sf_dir), "user_id", _ORDER, "delta"), "user_id", "event_id")


def pid_stable(spark, sf_dir):
    return c.pid_final(deltas(spark, sf_dir), "user_id", _ORDER, "delta").select("user_id", "stable")


def pid_reset(spark, sf_dir):
    """The feedback series, begun anew but for epsilon at each signup."""
    rows = deltas(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "signup").alias("again")), "event_id")
    return _rounded(c.pid_trace(rows, "user_id", _ORDER, "delta", reset=F.col("again")), "user_id", "event_id")


def warmup_errors(spark, sf_dir):
    """Warm-up of each user, which an error ends and which must settle within a week."""
    rows = table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return c.guarded_warmup(rows, "user_id", _ORDER, "value", 700.0, F.col("event_type") == "error", F.col("ms"), 7 * 86_400_000)


def normalize_errors(spark, sf_dir):
    """Orders' quantities towards targets that are too high or too low for some, and orders without volume."""
    shifted = _weights(spark, sf_dir).withColumn("weight", F.when(F.col("key") % 3 == 0, 0.0).otherwise(F.col("weight")))
    high = t.normalize_error(shifted.filter("key % 3 <> 1"), "key", ["idx"], "weight", 2.0**40)
    low = t.normalize_error(shifted.filter("key % 3 = 2"), "key", ["idx"], "weight", 2.0**-60)
    kind = lambda df, name: df.select(F.lit(name).alias("target"), "key", F.regexp_replace("error", "valor [0-9.E-]+", "valor x").alias("error"))
    return kind(high, "high").unionByName(kind(low, "low"))


def _weights(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").alias("weight"))


def volume_normalize(spark, sf_dir):
    return t.normalize(_weights(spark, sf_dir), "key", ["idx"], "weight", 100.0).select("key", "idx", F.round("weight", 6).alias("weight"),
        F.round("normalized", 8).alias("normalized"), "status")


def normalize_clamp(spark, sf_dir):
    return t.normalize_clamped_max(_weights(spark, sf_dir), "key", "weight", 100.0).select("key", F.round("largest", 8).alias("largest"))


def bounds_check(spark, sf_dir):
    shifted = _weights(spark, sf_dir).withColumn("weight", F.col("weight") - 3)
    return shifted.groupBy("key").agg(t.within_bounds("weight").alias("within"))


def volume_stable(spark, sf_dir):
    return _weights(spark, sf_dir).groupBy("key").agg(F.sum("weight").alias("volume")).select("key", "volume",
        t.volume_stable(F.col("volume"), 100.0, 0.05).alias("stable"))


def active_executions(spark, sf_dir):
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = table(spark, sf_dir, "events").select("user_id", *_ORDER, change.alias("change"))
    return c.active_count(rows, "user_id", _ORDER, "change", F.date_trunc("day", "ts")).select("event_id", "user_id", F.col("active").cast("long").alias("active"))


_D = (
    "d AS (SELECT user_id, event_id, (value - coalesce(lag(value) OVER w, value)) / 1000 AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY "
        "user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
_PID = (
    f"WITH RECURSIVE {_D}, p AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, max(n) AS n, 0.0::DOUBLE AS integral, 0.0::DOUBLE AS error, "
        f"0.5::DOUBLE AS epsilon FROM d GROUP BY 1 "
    "UNION ALL SELECT d.user_id, d.i, d.event_id, d.n, least(greatest(p.integral + (0.0 - d.x), -100.0), 100.0), 0.0 - d.x, "
    "least(greatest(p.epsilon + 0.5::DOUBLE * (0.0 - d.x) + 0.1::DOUBLE * least(greatest(p.integral + (0.0 - d.x), -100.0), 100.0) + 0.3::DOUBLE * "
        "((0.0 - d.x) - p.error), 0.001), 1.0) "
    "FROM p JOIN d ON d.user_id = p.user_id AND d.i = p.i + 1) ")
_ROUNDED = "round(integral, 8) AS integral, round(error, 8) AS error, round(epsilon, 8) AS epsilon"
_W = "w AS (SELECT l_orderkey AS key, l_linenumber AS idx, l_quantity AS weight, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)"
QUERIES = {f.__name__: f for f in (
    eps_variance, eps_oscillation, warmup_first_convergence, pid_final, pid_trace, pid_stable, volume_normalize, normalize_clamp, bounds_check,
        volume_stable, active_executions,
    pid_reset, warmup_errors, normalize_errors)}
ORACLES = {
    "eps_variance": "SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE var_pop(value) END, 6) AS variance, count(*) AS n FROM (SELECT *, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY 1",
    "eps_oscillation": "WITH l AS (SELECT user_id, value AS c, lag(value, 1) OVER w AS p, lag(value, 2) OVER w AS pp FROM events WINDOW w AS "
        "(PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE (c > p AND pp > p) OR (c < p AND "
        "pp < p)) AS extrema FROM l GROUP BY 1) SELECT user_id, n, extrema, CASE WHEN n < 4 THEN false ELSE extrema / (n - 2)::DOUBLE > 0.3 "
        "END AS oscillates FROM s",
    "warmup_first_convergence": "WITH v AS (SELECT user_id, row_number() OVER w AS i, var_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
        "ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, "
        "coalesce(min(i) FILTER (WHERE i >= 10 AND v < 700.0), max(i)) AS spikes_used, true AS converged FROM v GROUP BY 1",
    "pid_final": _PID + f"SELECT user_id, {_ROUNDED} FROM p WHERE i = n",
    "pid_trace": _PID + f"SELECT user_id, event_id, {_ROUNDED} FROM p WHERE i > 0",
    "pid_stable": _PID + "SELECT user_id, abs(integral) < 0.01 AND abs(error) < 0.001 AS stable FROM p WHERE i = n",
    "pid_reset": _PID.replace("row_number() OVER w AS i,", "row_number() OVER w AS i, event_type = 'signup' AS again,").replace("p.integral +",
        "CASE WHEN d.again THEN 0 ELSE p.integral END +").replace("- p.error",
        "- CASE WHEN d.again THEN 0 ELSE p.error END") + f"SELECT user_id, event_id, {_ROUNDED} FROM p WHERE i > 0",
    "warmup_errors": "WITH v AS (SELECT user_id, row_number() OVER w AS i, var_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS "
        "BETWEEN 9 PRECEDING AND CURRENT ROW) AS v, event_type = 'error' AS f, epoch_ms(ts) AS ms FROM events WINDOW w AS (PARTITION BY user_id "
        "ORDER BY ts, event_id)), "
    "s AS (SELECT user_id, min(i) FILTER (WHERE i >= 10 AND v < 700) AS s, min(i) FILTER (WHERE f) AS b, max(i) AS n, max(ms) - min(ms) AS took FROM "
        "v WHERE i <= 100 GROUP BY 1), "
    "q AS (SELECT *, b IS NOT NULL AND (s IS NULL OR b <= s) AS bad, s IS NULL AND took > 604800000 AS late FROM s) "
    "SELECT user_id, CASE WHEN bad THEN b - 1 ELSE coalesce(s, n) END AS spikes_used, NOT bad AND NOT late AS converged, CASE WHEN bad THEN 'Falha na "
        "convergência durante warm-up' WHEN late THEN 'Warm-up excedeu timeout de ' || took || 'ms' END AS error FROM q",
    "normalize_errors": "SELECT DISTINCT 'high' AS target, l_orderkey AS key, CASE WHEN l_orderkey % 3 = 0 THEN 'Volume total é zero, normalização "
        "impossível' WHEN max(l_quantity) * (power(2, 40) / sum(l_quantity)) > 4294967295 THEN 'Overflow: valor x excede u32::MAX' END AS error FROM "
        "lineitem WHERE l_orderkey % 3 <> 1 GROUP BY l_orderkey "
    "UNION ALL SELECT 'low', l_orderkey, CASE WHEN min(l_quantity) * (power(2, -60) / sum(l_quantity)) < 2.220446049250313e-16 THEN 'Underflow: valor "
        "x é muito pequeno' END FROM lineitem WHERE l_orderkey % 3 = 2 GROUP BY l_orderkey",
    "volume_normalize": f"WITH {_W}, o AS (SELECT *, weight * (100.0::DOUBLE / s) AS x FROM w) SELECT key, idx, round(weight, 6) AS weight, round(x, "
        f"8) AS normalized, 'Ok' AS status FROM o",
    "normalize_clamp": f"WITH {_W} SELECT key, round(max(least(greatest(weight * (100.0::DOUBLE / s), 0), 4294967295.0)), 8) AS largest FROM w GROUP BY 1",
    "bounds_check": "SELECT l_orderkey AS key, bool_and(l_quantity - 3 >= 0 AND l_quantity - 3 <= 4294967295.0) AS within FROM lineitem GROUP BY 1",
    "volume_stable": "SELECT l_orderkey AS key, sum(l_quantity) AS volume, abs(sum(l_quantity) - 100) / 100 < 0.05 AS stable FROM lineitem GROUP BY 1",
    "active_executions": "WITH RECURSIVE d AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS x, "
        "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), a AS (SELECT user_id, event_id, i, greatest(0, x)::BIGINT "
        "AS active FROM d WHERE i = 1 UNION ALL SELECT d.user_id, d.event_id, d.i, greatest(0, a.active + d.x)::BIGINT FROM a JOIN d ON d.user_id = "
        "a.user_id AND d.i = a.i + 1) SELECT event_id, user_id, active FROM a",
}
