"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass in the session that is there."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomline")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cores), **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of this machine where it is
    unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="loomline-")
        atexit.register(shutil.rmtree, shared_dir.own, ignore_errors=True)
    return shared_dir.own


#: Paths of durable tables that are still there, in the order in which they were made.
_MADE: dict[str, None] = {}


def _opened(df: DataFrame, path: str) -> DataFrame:
    """df, which reads a durable table at the path."""
    _MADE[path] = None
    df.durable_path = path
    return df


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.pop(path, None)


def _sweep() -> None:
    """At the application's end: what no one deleted. Without a session only local folders can still be reached."""
    spark = SparkSession.getActiveSession() if _MADE else None
    for path in list(_MADE):
        try:
            if spark:
                _delete(spark, path)
            elif "://" not in path:
                shutil.rmtree(path, ignore_errors=True)
        except Exception:  # noqa: BLE001 - the session is going down
            return


atexit.register(_sweep)


@contextmanager
def scope(spark: SparkSession, *kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Durable tables that are made within are deleted at the end, but those that are added to the list it gives. What
    is read from operators must be written or collected within."""
    before, keep = set(_MADE), list(kept)
    try:
        yield keep
    finally:
        own = {df.durable_path for df in keep}
        for path in [p for p in _MADE if p not in before and p not in own]:
            _delete(spark, path)


def packed(df: DataFrame, rows: int | None, each: int = 4096) -> DataFrame:
    """df, which has at most so many rows (None: unknown, df as it is), in partitions of about each rows, without an
    exchange and never in more than it has. A durable table of few rows is then few files: each file costs its task
    folders, renames and, where Hadoop sets a local file's mode, several child processes of the executor."""
    return df if rows is None else df.coalesce(max(1, math.ceil(rows / each)))


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return _opened(spark.read.schema(df.schema).parquet(path), path)


def durable_parts(df: DataFrame, kind: str, values: list[str], name: str = "step") -> list[DataFrame]:
    """As durable(), for rows of several kinds that are worked out together: a table for each value of the column kind,
    that can be discarded by itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(kind).parquet(path)
    schema = T.StructType([f for f in df.schema if f.name != kind])
    out = []
    for value in values:
        own = f"{path}/{kind}={value}"
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)  # no rows of a kind: no folder
        out.append(_opened(spark.read.schema(schema).parquet(own), own))
    return out


def durable_buckets(df: DataFrame, key: str, name: str = "step") -> DataFrame:
    """As durable(), in as many buckets of key as a shuffle has partitions: what is grouped or joined by key later need
    not be exchanged again. The catalog knows the table only while it is written and opened."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomline/{name}_{uuid.uuid4().hex}"
    known = f"spark_catalog.default.{path.rpartition('/')[2]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(known)
    out = spark.table(known)
    out.schema  # opened while the catalog has it
    spark.sql(f"DROP TABLE {known}")
    return _opened(out, path)


def discard(*tables: DataFrame) -> None:
    """Delete durable tables that nothing will read any more."""
    for df in tables:
        _delete(df.sparkSession, df.durable_path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that are done with: it does so when their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that its functions can run there."""
    app = spark.sparkContext.applicationId
    if getattr(ship, "to", None) == app:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it runs from an archive that was sent already
        return
    to = Path(tempfile.mkdtemp(prefix="loomline-")) / "loomline_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))
    ship.to = app
