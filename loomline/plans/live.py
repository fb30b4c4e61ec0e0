"""Streaming queries, each drained over what is there and held against the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.plans.series import ORACLES as SERIES
from loomline.plans.bindings import deltas
from loomline.session import durable, table
from loomline.sources.tables import scratch
from loomline.streaming import live


def stream_tumbling(spark, sf_dir):
    out = live.drain(live.tumbling(live.table_stream(spark, sf_dir, "events"), "ts", ["event_type"], "value"), "complete", "tumbling", table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark, sf_dir):
    out = live.drain(live.sliding(live.table_stream(spark, sf_dir, "events"), "ts", ["event_type"], "value", "2 hours", "1 hour"), "complete",
        "sliding", table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_counters(spark, sf_dir):
    return live.drain(live.counters(live.table_stream(spark, sf_dir, "events"), ["event_type"]), "complete", "counters", table(spark, sf_dir, "events"))


def stream_dedup(spark, sf_dir):
    rows = live.table_stream(spark, sf_dir, "events")
    return live.drain(live.once(rows.unionByName(rows), "ts", "event_id"), "append", "once",
        table(spark, sf_dir, "events")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_telemetry(spark, sf_dir):
    rows = live.table_stream(spark, sf_dir, "events")
    held = rows.select(F.lit(1).alias("packets"), (F.col("event_type") == "error").cast("long").alias("drops"), F.length("props").cast("long").alias("total_bytes"))
    return live.drain(live.telemetry(held), "complete", "telemetry", table(spark, sf_dir, "events"))


def stream_polling(spark, sf_dir):
    """The telemetry snapshot, polled once a second."""
    rows = live.table_stream(spark, sf_dir, "events")
    held = rows.select(F.lit(1).alias("packets"), (F.col("event_type") == "error").cast("long").alias("drops"), F.length("props").cast("long").alias("total_bytes"))
    return live.drain(live.telemetry(held), "complete", "polling", table(spark, sf_dir, "events"), "1 second")


def stream_pid(spark, sf_dir):
    """Changes are written first, as a stream can't look at rows before."""
    path = scratch(spark, "deltas")
    deltas(spark, sf_dir).withColumn("at",
        F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.format_string("%020d", "event_id")).cast("string")).write.parquet(path)
    schema = spark.read.parquet(path).schema
    out = live.drain(live.feedback(spark.readStream.schema(schema).parquet(path), "user_id", "at", "delta"), "update", "pid", spark.read.parquet(path))
    return durable(out, "pid").select("user_id", *[F.round(c, 8).alias(c) for c in ("integral", "error", "epsilon")])


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_counters, stream_dedup, stream_telemetry, stream_polling, stream_pid)}
ORACLES = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sliding": "SELECT date_trunc('hour', ts) - to_hours(k) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM "
        "events, (VALUES (0), (1)) v(k) GROUP BY 1, 2",
    "stream_counters": "SELECT event_type, count(*) AS total FROM events GROUP BY 1",
    "stream_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_telemetry": "SELECT count(*) AS packets, count(*) FILTER (WHERE event_type = 'error') AS drops, CAST(sum(length(props)) AS BIGINT) AS "
        "total_bytes FROM events",
    "stream_polling": "SELECT count(*) AS packets, count(*) FILTER (WHERE event_type = 'error') AS drops, CAST(sum(length(props)) AS BIGINT) AS total_bytes FROM events",
    "stream_pid": SERIES["pid_final"],
}
