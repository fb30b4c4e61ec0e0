"""Weights of a key: volume, normalisation, bounds."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline import errors

#: The largest weight that is held, and the least difference from zero.
MOST = 4294967295.0
EPSILON = sys.float_info.epsilon


def _with_volume(rows: DataFrame, key: str, weight: str, spread: bool) -> DataFrame:
    """rows with their key's volume: a window, or with spread partial sums that are joined back, for keys that may have
    very many rows."""
    if not spread:
        return rows.withColumn("_volume", F.sum(weight).over(Window.partitionBy(key)))
    sums = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(weight).alias("_volume"))
    return rows.join(sums, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def normalize(rows: DataFrame, key: str, idx: list[str], weight: str, target: float, spread: bool = False) -> DataFrame:
    """Weights times target / volume. A key with an error keeps its weights whole, and has the first error by idx as
    its status: ZeroVolume, Overflow or Underflow, else Ok."""
    held = _with_volume(rows, key, weight, spread)
    factor = F.lit(target) / F.when(F.abs("_volume") < EPSILON, None).otherwise(F.col("_volume"))
    scaled = held.withColumn("_scaled", F.col(weight) * factor)
    error = F.when(F.col("_scaled") > MOST, "Overflow").when((F.col("_scaled") > 0) & (F.col("_scaled") < EPSILON), "Underflow")
    found = F.min(F.when(error.isNotNull(), F.struct(*idx, error.alias("error"))))
    if spread:
        first = scaled.groupBy(F.col(key).alias("_key")).agg(found["error"].alias("_error"))
        out = scaled.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    else:
        out = scaled.withColumn("_error", found.over(Window.partitionBy(key))["error"])
    out = out.withColumn("status", F.when(F.abs("_volume") < EPSILON, "ZeroVolume").otherwise(F.coalesce("_error", F.lit("Ok"))))
    return out.withColumn("normalized", F.when(F.col("status") == "Ok", F.col("_scaled")).otherwise(F.col(weight))).drop("_volume", "_scaled", "_error")


def normalize_error(rows: DataFrame, key: str, idx: list[str], weight: str, target: float) -> DataFrame:
    """(key, error): what normalize() finds wrong with a key, as text that names its first bad scaled weight; else null."""
    held = _with_volume(normalize(rows, key, idx, weight, target), key, weight, False)
    scaled = F.col(weight) * F.try_divide(F.lit(target), F.col("_volume"))
    bad = F.when(F.col("status") == "Overflow", scaled > MOST).when(F.col("status") == "Underflow", (scaled > 0) & (scaled < EPSILON))
    first = held.groupBy(key).agg(F.first("status").alias("status"), F.min(F.when(bad, F.struct(*idx, scaled.alias("v"))))["v"].alias("v"))
    said = lambda text: F.concat(F.lit(text.split("{}")[0]), F.col("v").cast("string"), F.lit(text.split("{}")[1]))
    error = F.when(F.col("status") == "ZeroVolume", errors.ZERO_VOLUME).when(F.col("status") == "Overflow",
        said(errors.OVERFLOW)).when(F.col("status") == "Underflow", said(errors.UNDERFLOW))
    return first.select(key, error.alias("error"))


def clamped(w: Column) -> Column:
    """Into [0, MOST]; not a number stays so."""
    return F.when(F.isnan(w), w).otherwise(F.least(F.greatest(w, F.lit(0.0)), F.lit(MOST)))


def normalize_clamped_max(rows: DataFrame, key: str, weight: str, target: float, spread: bool = False) -> DataFrame:
    """(key, largest): the largest normalised and clamped weight; 0 of a key without volume."""
    held = _with_volume(rows.select(key, weight), key, weight, spread)
    scaled = clamped(F.col(weight) * F.try_divide(F.lit(target), F.col("_volume")))
    return held.groupBy(key).agg(F.coalesce(F.max(F.when((F.abs("_volume") >= EPSILON) & ~F.isnan(scaled), scaled)), F.lit(0.0)).alias("largest"))


def within_bounds(weight: str) -> Column:
    """All weights in [0, MOST]; true of none, false with any that is not a number."""
    return F.coalesce(F.bool_and(~F.isnan(weight) & F.col(weight).between(0.0, MOST)), F.lit(True))


def volume_stable(volume: Column, target: float, tolerance: float = 0.001) -> Column:
    return F.coalesce(F.try_divide(F.abs(volume - target), F.lit(target)) < tolerance, F.lit(False))
