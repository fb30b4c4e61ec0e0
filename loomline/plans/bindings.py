"""How operators' inputs are taken from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.control import next_by_parts
from loomline.session import table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their label k; ties of ts are broken by event_id."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousandth of each value's change from the user's one before; 0 at first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    change = (F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value"))) / 1000
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", change.alias("delta"))


def purchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive purchases of a day, as (a, b): all purchases, put in order by minutes."""
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.to_date("ts").alias("day"), "ts", "event_id", F.col("user_id").alias("a"))
    pairs = next_by_parts(bought, ["day"], ["ts", "event_id"], "a", F.date_trunc("minute", "ts"), "b")
    return pairs.select("a", "b").filter("b is not null")


PAIRS = "pairs AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events WHERE event_type = 'purchase')"
EDGES = f"{PAIRS}, edges AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM pairs WHERE b IS NOT NULL AND a <> b)"
NODES = "nodes AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase')"
