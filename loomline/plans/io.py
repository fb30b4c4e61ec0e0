"""Sources, sinks and batch functions, each read back and compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions.udf import Registry, identity, scaled
from loomline.plans.job import located_events
from loomline.session import table
from loomline.sources import tables as s

FUNCTIONS = Registry()
FUNCTIONS.register("identity", identity)
FUNCTIONS.register("double_quantity", scaled("l_quantity", 2.0))


def udf_identity(spark, sf_dir):
    return FUNCTIONS.apply("identity", table(spark, sf_dir, "events").select("event_id", "user_id", "value"))


def udf_scale(spark, sf_dir):
    return FUNCTIONS.apply("double_quantity", table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))


def receptor_typed(spark, sf_dir):
    schema = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").schema
    return s.reject_nulls(s.receive(spark, f"{sf_dir}/orders.parquet", schema), "o_orderkey")


def _by_type(df):
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def terminal_roundtrip(spark, sf_dir):
    path = s.scratch(spark, "terminal")
    s.terminal(table(spark, sf_dir, "events"), path)
    return _by_type(s.receive(spark, path))


def partitioned_roundtrip(spark, sf_dir):
    """The staged job's own sink: sums by region and hour, in a folder for each hour of the day."""
    path = s.scratch(spark, "partitioned")
    sums = located_events(spark, sf_dir).groupBy("region_id", F.hour("timestamp_hour").alias("timestamp_hour")).agg(F.sum("value").alias("sum_value"))
    s.terminal(sums, path, ["timestamp_hour"])
    return s.receive(spark, path).select("region_id", F.col("timestamp_hour").cast("int").alias("timestamp_hour"), F.round("sum_value", 4).alias("sum_value"))


def discovered_files(spark, sf_dir):
    """The sink's files as they are found, once each, and the rows in each folder."""
    path = s.scratch(spark, "discovered")
    files = s.terminal(table(spark, sf_dir, "events").select(F.hour("ts").alias("at"), "value"), path, ["at"])
    found = spark.createDataFrame([(f,) for f in files],
        "file string").select(F.regexp_extract("file", "at=([0-9]+)/part-[^/]*parquet$", 1).cast("int").alias("at")).distinct()
    return found.join(s.receive(spark, path).groupBy("at").agg(F.count(F.lit(1)).alias("n")), "at")


def first_registration(spark, sf_dir):
    """A name that is registered twice keeps its first function."""
    own = Registry()
    own.register("f", scaled("value", 3.0))
    own.register("f", scaled("value", 5.0))
    return own.apply("f", table(spark, sf_dir, "events").select("event_id", "value"))


def ipc_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return _by_type(s.from_ipc(s.to_ipc(rows), rows.schema))


def sensor_batch(spark, sf_dir):
    return s.sensors(spark, 50_000).withColumn("metric_value", F.round("metric_value", 6))


def staged_job_1m(spark, sf_dir):
    """The whole staged job over a million sensor rows: source, batch function, Parquet sink, sums by tag."""
    path = s.scratch(spark, "staged")
    s.terminal(FUNCTIONS.apply("identity", s.sensors(spark, 1_000_000)), path)
    sums = s.receive(spark, path).groupBy("sensor_tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metric_value"), 2).alias("total"))
    return sums


_BY_TYPE = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1"
QUERIES = {f.__name__: f for f in (udf_identity, udf_scale, receptor_typed, terminal_roundtrip, partitioned_roundtrip, discovered_files,
    first_registration, ipc_roundtrip, sensor_batch, staged_job_1m)}
ORACLES = {
    "udf_identity": "SELECT event_id, user_id, value FROM events",
    "udf_scale": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity FROM lineitem",
    "receptor_typed": "SELECT o_orderkey, o_totalprice FROM orders",
    "terminal_roundtrip": _BY_TYPE,
    "partitioned_roundtrip": "SELECT n_regionkey AS region_id, CAST(hour(ts) AS INT) AS timestamp_hour, round(sum(value), 4) AS sum_value FROM events "
        "e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2",
    "discovered_files": "SELECT CAST(hour(ts) AS INT) AS at, count(*) AS n FROM events GROUP BY 1",
    "first_registration": "SELECT event_id, value * 3 AS value FROM events",
    "ipc_roundtrip": _BY_TYPE,
    "staged_job_1m": "SELECT 'sensor_' || lpad((range % 50)::VARCHAR, 4, '0') AS sensor_tag, count(*) AS n, round(sum(range * 0.12345::DOUBLE), 2) AS "
        "total FROM range(1000000) GROUP BY 1",
    "sensor_batch": "SELECT range AS id, round(range * 0.12345::DOUBLE, 6) AS metric_value, 'sensor_' || lpad((range % 50)::VARCHAR, 4, '0') AS "
        "sensor_tag FROM range(50000)",
}
