"""Ordered control series: feedback recurrence, oscillation, variance and warm-up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline import errors
from loomline.session import ship


@dataclass(frozen=True)
class Pid:
    kp: float = 0.5
    ki: float = 0.1
    kd: float = 0.3
    low: float = 0.001
    high: float = 1.0
    windup: float = 100.0
    start: float = 0.5

    def step(self, integral: float, error: float, epsilon: float, delta: float) -> tuple[float, float, float]:
        """(integral, error, epsilon) after one observation; for tests and stateful streams."""
        e = 0.0 - delta
        i = min(max(integral + e, -self.windup), self.windup)
        return i, e, min(max(epsilon + self.kp * e + self.ki * i + self.kd * (e - error), self.low), self.high)


def _folded(rows: DataFrame, key: str, order: list[str], delta: str, pid: Pid, reset: Column | None, last: bool) -> DataFrame:
    """Keys' rows stream in their order past a state of three numbers, so a series may be of any length. reset: rows
    before whose step integral and error are cleared, while epsilon stays. A null observation counts as no change. With
    last only each key's state after its last row goes on."""
    ship(rows.sparkSession)
    cleared = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    held = rows.select(key, *order, cleared.alias("_reset"), F.col(delta).cast("double").alias("_delta"))
    held = held.repartition(key).sortWithinPartitions(key, *order)
    kept = T.StructType([f for f in held.schema if f.name == key or not last and f.name in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no key is that
        state = (0.0, 0.0, pid.start)
        n = len(kept.fields)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], keys),
                *[pa.array([r[1][i] for r in rows], pa.float64()) for i in range(3)]], [kept[0].name, *_STATE])

        for batch in batches:
            keys, out = batch.schema.field(0).type, []
            for k, clear, x in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(),
                batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if k != now:
                    if last and now is not run:
                        out.append((now, state))
                    now, state = k, (0.0, 0.0, pid.start)
                if clear:
                    state = (0.0, 0.0, state[2])
                state = pid.step(*state, x or 0.0)
                if not last:
                    out.append(state)
            if last:
                yield made(out)
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array([s[i] for s in out], pa.float64()) for i in range(3)]],
                    [*batch.schema.names[:n], *_STATE])
        if last and now is not run:
            yield made([(now, state)])

    return held.mapInArrow(run, T.StructType([*kept.fields, *[T.StructField(c, T.DoubleType()) for c in _STATE]]))


_STATE = ("integral", "error", "epsilon")


def pid_final(rows: DataFrame, key: str, order: list[str], delta: str, pid: Pid = Pid(), reset: Column | None = None) -> DataFrame:
    """(key, integral, error, epsilon, stable) after all observations: the last state of pid_trace()."""
    end = _folded(rows, key, order, delta, pid, reset, True)
    return end.withColumn("stable", (F.abs("integral") < 0.01) & (F.abs("error") < 0.001))


def pid_trace(rows: DataFrame, key: str, order: list[str], delta: str, pid: Pid = Pid(), reset: Column | None = None) -> DataFrame:
    """Every observation with the state after it. The recurrence is clamped at each step and so no window."""
    return _folded(rows, key, order, delta, pid, reset, False)


def next_by_parts(rows: DataFrame, keys: list[str], order: list[str], value: str, part: Column, name: str = "next") -> DataFrame:
    """rows with the value of the next row of their keys in that order, null at the end. part: something that never
    falls in that order, like the minute; rows are put in order within parts, and each part's first value is carried to
    the end of the part before, so that a key with very many rows is spread."""
    held = rows.withColumn("_part", part)
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    held = held.withColumn("_last", F.lead(F.lit(1)).over(w).isNull()).withColumn("_own", F.lead(value).over(w))
    firsts = held.groupBy(*keys, "_part").agg(F.min_by(value, F.struct(*order)).alias("_first"))
    after = firsts.select(*keys, "_part", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_part")).alias("_after"))
    out = held.join(after, [*keys, "_part"])
    return out.withColumn(name, F.when(F.col("_last"), F.col("_after")).otherwise(F.col("_own"))).drop("_part", "_last", "_own", "_after")


def series_variance(value: str) -> Column:
    """Population variance of a key's values; 0 of fewer than two."""
    return F.when(F.count(value) < 2, F.lit(0.0)).otherwise(F.var_pop(value))


def oscillation(rows: DataFrame, key: str, order: list[str], value: str, part: Column | None = None) -> DataFrame:
    """(key, n, extrema, oscillates): strict turns between neighbours, for more than 0.3 of the inner values; fewer
    than 4 values never oscillate. part: something that never falls in that order, by which a key with very many rows is
    spread."""
    held = rows.select(key, *order, F.col(value).alias("pp"), (F.lit(0) if part is None else part).alias("_slice"))
    if part is None:
        w = Window.partitionBy(key).orderBy(*order)
        held = held.withColumn("p", F.lead("pp", 1).over(w)).withColumn("c", F.lead("pp", 2).over(w))
    else:
        held = next_by_parts(next_by_parts(held, [key], order, "pp", F.col("_slice"), "p"), [key], order, "p", F.col("_slice"), "c")
    turn = ((F.col("c") > F.col("p")) & (F.col("pp") > F.col("p"))) | ((F.col("c") < F.col("p")) & (F.col("pp") < F.col("p")))
    sums = held.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(turn, F.lit(False)).cast("long")).alias("extrema"))
    share = F.col("extrema") / F.greatest(F.col("n") - 2, F.lit(1))
    return sums.withColumn("oscillates", F.when(F.col("n") < 4, False).otherwise(share > 0.3))


def warmup(rows: DataFrame, key: str, order: list[str], value: str, threshold: float, needed: int = 10) -> DataFrame:
    """(key, spikes_used, converged): the first spike at which the population variance of the last `needed` values is
    below the threshold; without one all spikes are used, and that counts as converged too."""
    w = Window.partitionBy(key).orderBy(*order)
    held = rows.select(key, F.row_number().over(w).alias("i"), F.var_pop(value).over(w.rowsBetween(1 - needed, 0)).alias("v"))
    good = F.when((F.col("i") >= needed) & (F.col("v") < threshold), F.col("i"))
    return held.groupBy(key).agg(F.coalesce(F.min(good), F.max("i")).cast("long").alias("spikes_used"), F.lit(True).alias("converged"))


def guarded_warmup(rows: DataFrame, key: str, order: list[str], value: str, threshold: float, failed: Column, elapsed_ms: Column,
    timeout_ms: int = 5000, needed: int = 10, most: int = 100) -> DataFrame:
    """(key, spikes_used, converged, error) of a warm-up that may fail, over each key's first `most` spikes. A spike that
    fails before the variance has settled ends it; one that never settles ends in a timeout if its last spike comes
    after more than timeout_ms since the first. spikes_used counts those that were processed."""
    w = Window.partitionBy(key).orderBy(*order)
    held = rows.select(key, F.row_number().over(w).alias("i"), F.var_pop(value).over(w.rowsBetween(1 - needed, 0)).alias("v"),
        F.coalesce(failed, F.lit(False)).alias("f"), elapsed_ms.alias("ms"))
    held = held.filter(F.col("i") <= most)
    settled, broke = F.min(F.when((F.col("i") >= needed) & (F.col("v") < threshold), F.col("i"))), F.min(F.when(F.col("f"), F.col("i")))
    sums = held.groupBy(key).agg(settled.alias("s"), broke.alias("b"), F.max("i").alias("n"), (F.max("ms") - F.min("ms")).cast("long").alias("took"))
    bad = F.col("b").isNotNull() & (F.col("s").isNull() | (F.col("b") <= F.col("s")))
    late = ~bad & F.col("s").isNull() & (F.col("took") > timeout_ms)
    before, after = errors.WARMUP_TIMEOUT.split("{}")
    error = F.when(bad, F.lit(errors.WARMUP_FAILED)).when(late, F.concat(F.lit(before), F.col("took").cast("string"), F.lit(after)))
    return sums.select(key, F.when(bad, F.col("b") - 1).otherwise(F.coalesce("s", "n")).cast("long").alias("spikes_used"),
        (~bad & ~late).alias("converged"), error.alias("error"))


def active_count(rows: DataFrame, key: str, order: list[str], change: str, part: Column | None = None) -> DataFrame:
    """Running sums that never fall below 0: a sum less its lowest value so far, which windows express. part: something
    that never falls in that order, like the hour; sums then run within parts, and parts' sums and lowest values are
    carried on, so that a key with very many rows is spread."""
    held = rows.withColumn("_part", F.lit(0) if part is None else part)
    run = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_s", F.sum(change).over(run)).withColumn("_low", F.min("_s").over(run))
    if part is None:
        return held.withColumn("active", F.col("_s") - F.least(F.lit(0), "_low")).drop("_part", "_s", "_low")
    ends = held.groupBy(key, "_part").agg(F.sum(change).alias("_sum"), F.min("_s").alias("_least"))
    w = Window.partitionBy(key).orderBy("_part")
    ends = ends.withColumn("_base", F.sum("_sum").over(w) - F.col("_sum"))
    ends = ends.select(key, "_part", "_base", F.min(F.col("_base") + F.col("_least")).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    now = F.col("_base") + F.col("_s")
    lowest = F.least(F.lit(0), F.col("_before"), F.col("_base") + F.col("_low"))  # nulls are passed over
    return held.join(ends, [key, "_part"]).withColumn("active", now - lowest).drop("_part", "_s", "_low", "_base", "_before")
