"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from loomline.operators.control import Pid, pid_final
from loomline.plans.bindings import deltas
from loomline.session import table
from loomline.streaming import live

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def files(spark, tmp_path):
    """Events in three files, in order of time."""
    rows = table(spark, DATA, "events").orderBy("ts", "event_id").collect()
    schema = table(spark, DATA, "events").schema
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), schema


def drained(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_tumbling_equals_batch(spark, files):
    stream = live.event_stream(spark, *files)
    got = drained(live.tumbling(stream, "ts", ["event_type"], "value", "1 hour"), "complete", "tumbling").collect()
    batch = table(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour")["start"].alias("w"),
        "event_type").agg(F.count("*").alias("n"))
    assert {(r.window_start, r.event_type, r.n) for r in got} == {(r.w, r.event_type, r.n) for r in batch.collect()}


def test_sliding_and_sessions(spark, files):
    stream = live.event_stream(spark, *files)
    n = table(spark, DATA, "events").count()
    assert drained(live.sliding(stream, "ts", ["event_type"], "value"), "complete", "sliding").agg(F.sum("n")).first()[0] == 2 * n
    got = drained(live.sessions(stream, "ts", "user_id"), "complete", "sessions")
    assert got.agg(F.sum("n")).first()[0] == n


def test_counters_and_dedup(spark, files):
    stream = live.event_stream(spark, *files)
    batch = {r.event_type: r["count"] for r in table(spark, DATA, "events").groupBy("event_type").count().collect()}
    assert {r.event_type: r.total for r in drained(live.counters(stream, ["event_type"]), "complete", "totals").collect()} == batch
    twice = stream.unionByName(live.event_stream(spark, *files))
    assert drained(live.once(twice, "ts", "event_id"), "append", "once").count() == sum(batch.values())


def test_feedback_state_equals_batch_fold(spark, tmp_path):
    rows = deltas(spark, DATA).orderBy("ts", "event_id").collect()
    schema = "user_id long, ts timestamp_ntz, event_id long, delta double"
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame([(r.user_id, r.ts, r.event_id, r.delta) for r in part], schema).withColumn("seq",
            F.lit(k) * 10**9 + F.monotonically_increasing_id()).coalesce(1).write.parquet(str(tmp_path / f"p/{k}"))
    order = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "p"))
    ordered = {}
    for k in range(3):
        stream_schema = order.schema
        stream = spark.readStream.schema(stream_schema).parquet(str(tmp_path / f"p/{k}"))
        df = live.feedback(stream.withColumn("at", F.struct("ts", "event_id").cast("string")), "user_id", "at", "delta", Pid())
        ordered[k] = drained(df, "update", f"pid{k}").collect()
    # each part alone equals the fold of that part
    for k in range(3):
        part = spark.read.parquet(str(tmp_path / f"p/{k}"))
        want = {r.user_id: (round(r.integral, 9), round(r.epsilon, 9)) for r in pid_final(part, "user_id", ["ts", "event_id"], "delta").collect()}
        assert {r.user_id: (round(r.integral, 9), round(r.epsilon, 9)) for r in ordered[k]} == want


def test_feedback_keeps_state_between_batches(spark, tmp_path):
    for k, part in enumerate([[0.1], [0.0], [-0.1]]):
        spark.createDataFrame([(1, k, v) for v in part], "key long, seq long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live_stream(spark, str(tmp_path / "in"))
    out = drained(live.feedback(stream, "key", "seq", "x"), "update", "pid_state").collect()
    assert sorted(round(r.epsilon, 9) for r in out)[-1] > 0.4 and len(out) == 3


def live_stream(spark, path):
    return spark.readStream.schema("key long, seq long, x double").option("maxFilesPerTrigger", 1).parquet(path)
