"""Streaming twins of the batch operators, over any streaming source of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.operators.control import Pid
from loomline.session import ship
from loomline.sources.tables import scratch


def event_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream, with the event time as a timestamp of the session's zone (UTC)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(stream: DataFrame, ts: str, keys: list[str], value: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than the watermark are dropped."""
    held = stream.withWatermark(ts, late).groupBy(F.window(ts, length), *keys)
    return held.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(stream: DataFrame, ts: str, keys: list[str], value: str, length: str = "10 minutes", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    held = stream.withWatermark(ts, late).groupBy(F.window(ts, length, step), *keys)
    return held.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    held = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return held.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def counters(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running totals, for update or complete mode."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def telemetry(stream: DataFrame) -> DataFrame:
    """The sum of all cpus' counters so far."""
    return stream.agg(*[F.sum(c).alias(c) for c in ("packets", "drops", "total_bytes")])


def feedback(stream: DataFrame, key: str, order: str, delta: str, pid: Pid = Pid()) -> DataFrame:
    """The feedback recurrence as state of each key: a row with the state after each batch's rows, in their order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else (0.0, 0.0, pid.start)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[delta]:
            at = pid.step(*at, x)
        state.update(tuple(map(float, at)))
        yield pd.DataFrame({key: [k[0]], "integral": [at[0]], "error": [at[1]], "epsilon": [at[2]], "n": [len(rows)]})

    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, integral double, error double, epsilon double, n long", "integral double, error double, epsilon double", "update",
            GroupStateTimeout.NoTimeout)


def merge_into(path: str, key: str, heartbeat: str):
    """A foreachBatch sink that merges gossip into a table of members: the latest heartbeat wins, ties keep the first.
    Each batch writes a version of the table, made of its rows and the whole version before. A version counts once it is
    whole, and a batch that is run again writes the same version again, so that a crash at any time loses nothing."""
    from loomline.operators.cluster import gossip_merge

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_old", F.lit(1))
        before = [v for v in versions(spark, path) if v < number]
        if before:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v={before[-1]}").withColumn("_old", F.lit(0)))
        merged = gossip_merge(rows.withColumn("_seq", F.col("_old") * (1 << 40) + F.col("seq")), key, heartbeat, "_seq").drop("_old", "_seq")
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")
        for old in before[:-1]:
            _remove(spark, f"{path}/v={old}")

    return run


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a table that merge_into() wrote, the latest last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in whole)


def members(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table_stream(spark: SparkSession, sf_dir: str, name: str, ts: str = "ts") -> DataFrame:
    """A table as a stream of files, be it a folder of part files or a single file."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream is of folders only
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def drain(stream: DataFrame, mode: str, name: str, source: DataFrame, every: str | None = None) -> DataFrame:
    """Everything that is there now through the stream: in append mode all batches' rows, else the last batch's.
    A batch that is run again overwrites its own folder. source is the streamed table as a batch: if it has rows and
    the stream gave no batch, that is an error. every: poll at that pace, like "1 second", until all is read; else what
    is there is read at once."""
    path = scratch(stream.sparkSession, name)
    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        seen.append(number)

    pace = {"processingTime": every} if every else {"availableNow": True}
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(**pace).start()
    if every:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
    batches = sorted(set(seen)) if mode == "append" else sorted(set(seen))[-1:]
    spark = stream.sparkSession
    if not batches and not source.isEmpty():
        raise RuntimeError(f"{name}: the stream gave no batch of a table with rows")
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch-{n}" for n in batches]) if batches else spark.createDataFrame([], stream.schema)
