"""Typed sources and sinks: Parquet with a checked schema, Arrow IPC files as rows, exposition text, sensor rows."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.errors import SchemaError
from loomline.session import shared_dir, ship


def receive(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, refused if a column of the schema is missing or has another type."""
    df = spark.read.parquet(path)
    for f in schema or ():
        if f.name not in df.columns:
            raise SchemaError(f"column {f.name} is missing")
        if df.schema[f.name].dataType != f.dataType:
            raise SchemaError(f"column {f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*[f.name for f in schema]) if schema else df


def reject_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Fails at run time on a null in a column that may have none."""
    checks = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"column {c} has a null"))).otherwise(F.col(c)).alias(c) for c in columns]
    return df.select(*[c for c in df.columns if c not in columns], *checks).select(*df.columns)


def terminal(df: DataFrame, path: str, partition_by: list[str] | None = None) -> list[str]:
    """Snappy Parquet in place of what was there; the files written. Partitioned output is dealt by its keys first, so
    that each folder has few files."""
    rows = df.repartition(*partition_by) if partition_by else df
    writer = rows.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return discover(df.sparkSession, path)


def discover(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files below a path, once each, by name."""
    return sorted(set(spark.read.parquet(path).inputFiles()))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"


def to_ipc(df: DataFrame) -> DataFrame:
    """One row for each partition's batch: an Arrow IPC file with schema and footer."""

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n_rows", "ipc"])

    ship(df.sparkSession)
    return df.mapInArrow(run, "n_rows long, ipc binary")


def from_ipc(files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of IPC files; bytes that are none raise."""

    def run(batches):
        for b in batches:
            for data in b.column(b.schema.get_field_index("ipc")).to_pylist():
                with pa.ipc.open_file(pa.BufferReader(data)) as r:
                    for i in range(r.num_record_batches):
                        yield r.get_batch(i)

    ship(files.sparkSession)
    return files.select("ipc").mapInArrow(run, schema)


def sensors(spark: SparkSession, n: int) -> DataFrame:
    """id, metric_value and one of fifty tags."""
    return spark.range(n).select("id", (F.col("id") * 0.12345).alias("metric_value"), F.format_string("sensor_%04d", F.col("id") % 50).alias("sensor_tag"))
