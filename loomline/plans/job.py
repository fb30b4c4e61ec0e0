"""The staged job: typed source, batch-wise function, grouped sum, partitioned sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import table


def located_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the region of their user and the hour they fall in."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("region_id"))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp_hour")
    return events.join(customer, "user_id").join(nation, "n_nationkey").select("region_id", hour, "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = located_events(spark, sf_dir).groupBy("region_id", "timestamp_hour")
    return out.agg(F.round(F.sum("value"), 6).alias("sum_value"), F.count(F.lit(1)).alias("n_events"))


def region_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located_events(spark, sf_dir).groupBy("region_id").agg(F.round(F.sum("value"), 4).alias("sum_value"), F.count(F.lit(1)).alias("n_events"))


_LOCATED = "events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"
QUERIES = {"flagship_region_hour_sum": flagship, "region_sum": region_sum}
ORACLES = {
    "flagship_region_hour_sum": f"SELECT n_regionkey AS region_id, date_trunc('hour', ts) AS timestamp_hour, round(sum(value), 6) AS sum_value, "
        f"count(*) AS n_events FROM {_LOCATED} GROUP BY 1, 2",
    "region_sum": f"SELECT n_regionkey AS region_id, round(sum(value), 4) AS sum_value, count(*) AS n_events FROM {_LOCATED} GROUP BY 1",
}
