"""Labelled counters, gauges, latency statistics and service levels over metric rows.

Running values are windows by key, final ones aggregates that combine on the map side. Percentiles take the element at
floor(q * n) of the ascending values (at most the last), which is neither the interpolated nor the ceiling rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 1000


def series_key(name: Column, labels: Column) -> Column:
    """name and the labels as k=v in order of k, joined by underscores."""
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("_", name, F.array_sort(pairs))


def counter_totals(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))


def counter_log(rows: DataFrame, key: str, order: list[str], part: Column | None = None) -> DataFrame:
    """Every increment with its key's running total. part: something that never falls in that order, like the hour; rows
    are then numbered within parts and parts' totals are added up, so that a key with very many rows is spread."""
    if part is None:
        return rows.withColumn("running", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    held = rows.withColumn("_part", part)
    sums = held.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select(key, "_part", (F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    return held.withColumn("_own", own).join(before, [key, "_part"]).withColumn("running",
        (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def gauge_last(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("value"))


def exposition(counters: DataFrame, gauges: DataFrame) -> DataFrame:
    """(key, total) and (key, value) -> lines of text, counters before gauges, each in order of key."""
    line = lambda v: F.concat_ws(" ", "key", F.col(v).cast("string")).alias("line")
    return counters.select(F.lit(0).alias("part"), line("total")).unionByName(gauges.select(F.lit(1).alias("part"), line("value")))


def sli(success: Column) -> Column:
    """Share of successes over all time; 1.0 of nothing."""
    return F.coalesce(F.avg(success.cast("double")), F.lit(1.0))


def error_budget(target: Column) -> Column:
    """In percent."""
    return (F.lit(1.0) - target) * 100


def _ranks(q: float) -> Column:
    return F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)


def at_rank_of_few(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """at_rank() for keys whose rows are bounded in number: one window."""
    w = Window.partitionBy(*keys)
    ranked = rows.filter(F.col(value).isNotNull()).select(*keys, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_rank"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_rank") == _ranks(q), F.col(value))).alias(name) for name, q in quantiles.items()])


#: How finely a sketch brackets a rank before it is counted out.
ACCURACY = 10_000


def at_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The values at floor(q * n), at most n - 1, counted from 0 in ascending order, for each key; exact, whatever a
    key's rows. A mergeable sketch brackets each rank, rows below the bracket are counted, and only those within it,
    summed up by value, are put in order. Nulls don't count."""
    held = rows.filter(F.col(value).isNotNull()).select(*keys, value)
    names = list(quantiles)
    edges = [min(max(quantiles[n] + d, 0.0), 1.0) for n in names for d in (-2 / ACCURACY, 2 / ACCURACY)]
    bounds = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, edges, ACCURACY).alias("_b"))
    near = held.join(bounds, keys)
    low, high = ([F.col("_b")[2 * i + d] for i in range(len(names))] for d in (0, 1))
    inside = [(F.col(value) >= low[i]) & (F.col(value) <= high[i]) for i in range(len(names))]
    some = inside[0]
    for x in inside[1:]:
        some = some | x
    under = near.groupBy(*keys).agg(F.first("_n").alias("_n"), F.first("_b").alias("_b"),
        *[F.sum((F.col(value) < low[i]).cast("long")).alias(f"_under{i}") for i in range(len(names))])
    counted = near.filter(some).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")).join(under, keys)
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = [(F.col(f"_under{i}") + F.sum(F.when(inside[i], F.col("_c")).otherwise(0)).over(w)).alias(f"_upto{i}") for i in range(len(names))]
    placed = counted.select(*keys, value, "_n", *[x.alias(f"_in{i}") for i, x in enumerate(inside)], *upto)
    picked = [F.min(F.when(F.col(f"_in{i}") & (F.col(f"_upto{i}") > _ranks(quantiles[n])), F.col(value))).alias(n) for i, n in enumerate(names)]
    return placed.groupBy(*keys).agg(*picked)


def recent(rows: DataFrame, keys: list[str], order: list[str], samples: int = SAMPLES) -> DataFrame:
    """The last so many rows of each key."""
    if samples < 1:
        raise ValueError("a history holds one sample at least")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("_recent", rank).filter(F.col("_recent") <= samples).drop("_recent")


def p95_recent(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return at_rank_of_few(recent(rows, keys, order), keys, value, {"p95": 0.95})


def run_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, population deviation, coefficient of variation in percent, extremes and percentiles of timed runs."""
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), F.min(value).alias("low"), F.max(value).alias("high"))
    sums = sums.withColumn("cv_percent", F.when(F.col("mean") > 0, F.col("sigma") / F.col("mean") * 100).otherwise(0.0))
    return sums.join(at_rank(rows, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), keys)


def throughput(mean_ms: Column, rows: Column, n_bytes: Column) -> tuple[Column, Column]:
    """(rows, MB of 2**20 bytes) a second; 0 of no time."""
    per_s = lambda x: F.when(mean_ms > 0, x / (mean_ms / 1000)).otherwise(F.lit(0.0))
    return per_s(rows.cast("double")), per_s(n_bytes / float(1 << 20))


COUNTERS = ("packets", "drops", "total_bytes", "latency", "latency_samples")


def per_cpu(records: DataFrame) -> DataFrame:
    """(cpu, bytes, dropped, latency_ns) of each packet -> counters of each cpu; latency counts if it isn't 0."""
    return records.groupBy("cpu").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("dropped").cast("long")).alias("drops"), F.sum("bytes").alias("total_bytes"),
        F.sum("latency_ns").alias("latency"), F.sum((F.col("latency_ns") != 0).cast("long")).alias("latency_samples"))


def snapshot(counters: DataFrame) -> DataFrame:
    return counters.agg(F.count(F.lit(1)).alias("cpu_count"), *[F.sum(c).alias(c) for c in COUNTERS])


def since_reset(rows: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Rows of the latest epoch: a reset begins a new one."""
    latest = rows.agg(F.max(epoch).alias(epoch))
    return rows.join(F.broadcast(latest), epoch)  # one row


#: The alert rules: name, what is watched, the window, and from which value on it is an alert, by severity.
ALERTS = (
    ("availability_below_99_percent", "availability", "5 minutes", "<", 0.99, "critical"),
    ("latency_p95_above_1s", "p95", "5 minutes", ">", 1000.0, "critical"),
    ("error_rate_above_5_percent", "error_rate", "5 minutes", ">", 0.05, "critical"),
    ("cluster_less_than_3_nodes", "healthy_nodes", "2 minutes", "<", 3, "critical"),
    ("latency_p95_above_500ms", "p95", "5 minutes", ">", 500.0, "warning"),
    ("error_rate_above_1_percent", "error_rate", "5 minutes", ">", 0.01, "warning"),
    ("quota_usage_above_80_percent", "quota_usage", "10 minutes", ">", 0.8, "warning"),
)


def service_windows(rows: DataFrame, ts: str, success: Column, latency: str, length: str = "5 minutes") -> DataFrame:
    """Tumbling windows: (window_start, n, availability, p95, error_rate)."""
    held = rows.select(F.window(ts, length)["start"].alias("window_start"), success.cast("double").alias("ok"), latency)
    sums = held.groupBy("window_start").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("availability"))
    out = sums.join(at_rank(held, ["window_start"], latency, {"p95": 0.95}), "window_start")
    return out.select("window_start", "n", "availability", "p95", (1 - F.col("availability")).alias("error_rate"))


def node_windows(rows: DataFrame, ts: str, node: str, healthy: Column, order: list[str], length: str = "2 minutes") -> DataFrame:
    """(window_start, healthy_nodes): nodes whose last report in the window is healthy."""
    held = rows.select(F.window(ts, length)["start"].alias("window_start"), node, *[c for c in order if c != node], healthy.alias("_healthy"))
    last = held.groupBy("window_start", node).agg(F.max_by("_healthy", F.struct(*order)).alias("ok"))
    return last.groupBy("window_start").agg(F.sum(F.col("ok").cast("long")).alias("healthy_nodes"))


def quota_windows(rows: DataFrame, ts: str, tenant: str, used: Column, total: Column, length: str = "10 minutes") -> DataFrame:
    """(window_start, tenant, quota_usage): the most that a tenant uses at once in the window, as a share of its quota."""
    held = rows.select(F.window(ts, length)["start"].alias("window_start"), tenant, (used / total).alias("_share"))
    return held.groupBy("window_start", tenant).agg(F.max("_share").alias("quota_usage"))


def raised(windows: DataFrame, keys: list[str], severity: str | None = None, rules=ALERTS) -> DataFrame:
    """(keys, alert, severity, value): a row for each rule that a window breaks; rules on columns it lacks are left out."""
    own = [r for r in rules if r[1] in windows.columns and severity in (None, r[5])]
    broken = lambda c, sign, x: F.col(c) < x if sign == "<" else F.col(c) > x
    found = F.array(*[F.when(broken(c, sign, x),
        F.struct(F.lit(name).alias("alert"), F.lit(s).alias("severity"), F.col(c).cast("double").alias("value"))) for name, c, _, sign, x, s in own])
    return windows.select(*keys, F.explode(F.array_compact(found)).alias("a")).select(*keys, "a.*")


def windowed_alerts(rows: DataFrame, ts: str, success: Column, latency: str, length: str = "5 minutes", availability: float = 0.99,
    p95: float = 1000.0, errors: float = 0.05) -> DataFrame:
    """Tumbling windows with their availability, p95 and error rate, and the alerts that they raise."""
    out = service_windows(rows, ts, success, latency, length)
    return out.select("window_start", "n", "availability", "p95", (F.col("availability") < availability).alias("low_availability"),
        (F.col("p95") > p95).alias("slow"), (F.col("error_rate") > errors).alias("failing"))


def rollbacks(rows: DataFrame, keys: list[str], ts: str, success: Column, latency: str, order: list[str], target: float = 0.99, errors: float = 0.05,
    p95: float = 1000.0, length: str = "2 minutes", streak: int = 3) -> DataFrame:
    """(keys, error_rate, slow_windows, longest, budget_used, and the four triggers): an error rate above `errors`, any
    window of `length` with a p95 above its limit, more than `streak` failures one after another, and an error budget
    (1 - target) that is used up."""
    held = rows.withColumns({"_ok": success, "_start": F.window(ts, length)["start"]})
    rate = held.groupBy(*keys).agg((1 - F.avg(F.col("_ok").cast("double"))).alias("error_rate"))
    slow = at_rank(held, [*keys, "_start"], latency, {"p95": 0.95}).groupBy(*keys).agg(F.sum((F.col("p95") > p95).cast("long")).alias("slow_windows"))
    run = longest_streak(held, keys, order, ~F.col("_ok"))
    out = rate.join(slow, keys, "left").join(run, keys, "left").withColumn("slow_windows", F.coalesce("slow_windows", F.lit(0).cast("long")))
    out = out.withColumn("budget_used", F.col("error_rate") / (1 - target))
    return out.withColumns({
        "failing": F.col("error_rate") > errors, "slow": F.col("slow_windows") > 0, "unhealthy": F.col("longest") > streak, "exhausted": F.col("budget_used") >= 1})


def rates(rows: DataFrame, ts: str, keys: list[str], length: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Increments per second in tumbling windows."""
    return rows.groupBy(*keys, F.window(ts, length)["start"].alias("window_start")).agg((F.count(F.lit(1)) / seconds).alias("rate"))


def longest_streak(rows: DataFrame, keys: list[str], order: list[str], failed: Column, part: Column | None = None) -> DataFrame:
    """The longest run of consecutive failures of each key: rows between two successes share a count of successes. part:
    something that never falls in that order, like the hour; runs are then found within parts and joined across them, so
    that a key with very many rows is spread."""
    held = rows.select(*keys, *order, failed.alias("_failed"), (F.lit(0) if part is None else part).alias("_part"))
    own = [*keys, "_part"]
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = held.withColumn("_island", F.sum((~F.col("_failed")).cast("long")).over(w))
    runs = island.groupBy(*own, "_island").agg(F.sum(F.col("_failed").cast("long")).alias("_run"))
    ends = runs.groupBy(*own).agg(
        F.max("_run").alias("_most"), F.max("_island").alias("_last"), F.max_by("_run", "_island").alias("_tail"),
            F.max(F.when(F.col("_island") == 0, F.col("_run"))).alias("_head"))
    if part is None:
        return ends.groupBy(*keys).agg(F.max("_most").alias("longest"))
    # A run goes on from a part's tail through parts that fail as a whole to the head of the next.
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col("_last") == 0
    chain = ends.withColumn("_chain", F.sum((~whole).cast("long")).over(across))
    joined = chain.groupBy(*keys, "_chain").agg(
        F.sum(F.when(whole, F.col("_tail")).otherwise(0)).alias("_whole"), F.max(F.when(~whole, F.col("_tail"))).alias("_tail"),
            F.max(F.when(~whole, F.col("_head"))).alias("_head"), F.max("_most").alias("_most"))
    after = F.lead("_head").over(Window.partitionBy(*keys).orderBy("_chain"))
    joined = joined.withColumn("_joined", F.coalesce("_tail", F.lit(0)) + F.col("_whole") + F.coalesce(after, F.lit(0)))
    return joined.groupBy(*keys).agg(F.max(F.greatest("_most", "_joined")).alias("longest"))


def stage_total(times: Column) -> Column:
    """The sum of a map's values."""
    return F.aggregate(F.map_values(times), F.lit(0).cast("long"), lambda a, x: a + x)


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets: (keys, le, n) with the rows at or below each bound, and all under infinity."""
    at = F.explode(F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf"))))
    held = rows.select(*keys, F.col(value), at.alias("le"))
    return held.groupBy(*keys, "le").agg(F.sum((F.col(value) <= F.col("le")).cast("long")).alias("n"))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The quantile by linear interpolation within its bucket, from 0 in the lowest; the highest finite bound beyond."""
    w = Window.partitionBy(*keys).orderBy("le")
    held = buckets.select(*keys, "le", "n", F.coalesce(F.lag("n").over(w), F.lit(0)).alias("below"),
        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"), F.max("n").over(Window.partitionBy(*keys)).alias("total"))
    rank = F.lit(q) * F.col("total")
    hit = held.filter((F.col("n") >= rank) & (F.col("below") < rank))
    inner = F.col("low") + (F.col("le") - F.col("low")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))
    return hit.select(*keys, F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inner).alias("quantile"))
