"""Task, performance and system statistics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from pagemill import fixed_values as fixed
from pagemill.functions.common import round_to, share
from pagemill.plans.ordered import exact_percentiles, join_null_safe, row_index, running_totals, trailing_window


def latest_time(df: DataFrame, column: str) -> datetime:
    """The newest timestamp, as the clock of window queries (one value, from one narrow column)."""
    return df.agg(F.max(column)).first()[0]


def since(df: DataFrame, column: str, as_of: datetime, **back: int) -> DataFrame:
    """Rows not older than ``as_of`` minus ``back``; the literal bound reaches the scan."""
    return df.filter(F.col(column) >= F.lit(as_of - timedelta(**back)))


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


# --- tasks -------------------------------------------------------------------


def task_statistics(tasks: DataFrame) -> DataFrame:
    """Count, success rate in percent and mean duration; zeros when there are no tasks."""
    return tasks.agg(
        F.count("*").alias("total_tasks"),
        _zero(share(F.col("status") == "completed")).alias("success_rate"),
        _zero(F.avg("duration")).alias("average_duration"),
    )


def status_breakdown(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.col("status").isNotNull()).groupBy("status").agg(F.count("*").alias("tasks")).orderBy(
        F.desc("tasks"), "status"
    )


def hourly_distribution(tasks: DataFrame, column: str = "created_at") -> DataFrame:
    return tasks.groupBy(F.hour(column).alias("hour")).agg(F.count("*").alias("tasks")).orderBy("hour")


def daily_distribution(tasks: DataFrame, column: str = "created_at") -> DataFrame:
    return tasks.groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("tasks")).orderBy("day")


def response_times(df: DataFrame, keys: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Mean, median and 95th percentile of the response time.

    Exact by default, at any size; ``approximate`` trades that for a single pass.
    """
    value = F.col("response_time")
    mean = _zero(F.avg(value)).alias("mean")
    if approximate:
        return df.groupBy(*keys).agg(
            mean, F.percentile_approx(value, 0.5).alias("median"), F.percentile_approx(value, 0.95).alias("p95")
        )
    means = df.groupBy(*keys).agg(mean)
    ranks = exact_percentiles(df, "response_time", {"median": 0.5, "p95": 0.95}, keys)
    if keys:
        joined = join_null_safe(means, ranks, keys, "left")
    else:
        joined = means.unionByName(ranks, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("mean", "median", "p95")])
    return joined.select(*keys, "mean", _zero(F.col("median")).alias("median"), _zero(F.col("p95")).alias("p95"))


def outcome_rates(df: DataFrame) -> DataFrame:
    return df.agg(
        _zero(share(F.col("status") == "error")).alias("error_rates"),
        _zero(share(F.col("status") == "success")).alias("success_rates"),
    )


def task_analytics(tasks: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Count, success rate and mean run time of tasks created in the last ``days``."""
    recent = since(tasks, "created_at", as_of, days=days)
    seconds = (F.unix_micros("completed_at") - F.unix_micros("created_at")) / 1_000_000
    out = recent.agg(
        F.count("*").alias("total_tasks"),
        share(F.col("status") == "completed").alias("_success"),
        F.avg(seconds).alias("_duration"),
    )
    return out.select(
        "total_tasks",
        _zero(round_to(F.col("_success"), 2)).alias("success_rate"),
        F.when(F.col("_duration") > 0, round_to(F.col("_duration"), 2)).otherwise(0.0).alias("avg_duration"),
    )


def active_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count_if(F.col("status") == "processing").alias("active_tasks"), F.count("*").alias("total_tasks")
    )


def latest(df: DataFrame, limit: int, column: str = "timestamp", tie: str = "task_id") -> DataFrame:
    """The newest ``limit`` rows, newest first."""
    return df.orderBy(F.desc(column), F.desc(tie)).limit(limit)


def performance_summary(metrics: DataFrame, limit: int = 100, tie: str = "task_id") -> DataFrame:
    """Rates over the newest task metrics; the mean duration leaves zeros out."""
    recent = latest(metrics.select(tie, "timestamp", "status", "duration"), limit, tie=tie)
    return recent.agg(
        F.count("*").alias("total_tasks"),
        _zero(share(F.col("status") == "completed")).alias("success_rate"),
        _zero(share(F.col("status") == "failed")).alias("error_rate"),
        _zero(F.avg(F.when(F.col("duration") != 0, F.col("duration")))).alias("average_duration"),
        F.count_if(F.col("status") == "completed").alias("successful_tasks"),
        F.count_if(F.col("status") == "failed").alias("failed_tasks"),
    )


# --- system ------------------------------------------------------------------


def system_analytics(metrics: DataFrame, as_of: datetime, hours: int = 24, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and peak load of the last ``hours``."""
    recent = since(metrics, "timestamp", as_of, hours=hours)
    means = {"cpu_avg": "cpu_percent", "memory_avg": "memory_percent", "disk_avg": "disk_percent"}
    peaks = {"peak_cpu": "cpu_percent", "peak_memory": "memory_percent"}
    return recent.groupBy(*keys).agg(
        *[_zero(round_to(F.avg(c), 2)).alias(name) for name, c in means.items()],
        *[_zero(round_to(F.max(c), 2)).alias(name) for name, c in peaks.items()],
        F.count("*").alias("data_points"),
    )


def trend(metrics: DataFrame, keys: Sequence[str], tie: str, column: str = "cpu_percent") -> DataFrame:
    """Direction of ``column`` per key from the least-squares slope over the row index."""
    needed = metrics.select(*keys, "timestamp", tie, column)
    indexed = row_index(needed, [F.col("timestamp").asc(), F.col(tie).asc()], keys)
    fitted = indexed.groupBy(*keys).agg(
        F.regr_slope(F.col(column), F.col("row_index")).alias("slope"), F.count("*").alias("data_points")
    )
    label = F.when((F.col("data_points") > 1) & (F.col("slope") > 0.1), "increasing").when(
        (F.col("data_points") > 1) & (F.col("slope") < -0.1), "decreasing"
    )
    return fitted.withColumn("trend", label.otherwise("stable"))


def time_series(df: DataFrame, time: str, value: str, bucket: str | None = None) -> DataFrame:
    """(timestamp, value) in time order; with ``bucket`` (such as ``1 hour``) the mean per bucket."""
    typed = df.select(F.col(time).cast("timestamp").alias("timestamp"), F.col(value).cast("double").alias("value"))
    if bucket:
        start = F.window("timestamp", bucket)["start"]
        typed = typed.groupBy(start.alias("timestamp")).agg(F.avg("value").alias("value"), F.count("*").alias("points"))
    return typed.orderBy("timestamp")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; bin 0 lies below ``low``, bin ``bins + 1`` at or above ``high``."""
    bin_ = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return df.filter(F.col(value).isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("rows"))


def heatmap(df: DataFrame, x: str, y: str, value: str, columns: list, other: str | None = None) -> DataFrame:
    """Mean of ``value`` for x by y, 0 where there is no row; ``columns`` lists the values of y.

    Values of y that are not listed, null included, go to the column ``other``; without one they are an error.
    """
    listed = F.col(y).isin(*columns)
    stray = F.lit(other) if other else F.raise_error(F.concat(F.lit(f"{y} has a value that is not listed: "), F.coalesce(F.col(y).cast("string"), F.lit("null"))))
    named = df.withColumn(y, F.when(listed, F.col(y).cast("string")).otherwise(stray))
    wanted = [str(c) for c in columns] + ([other] if other else [])
    return named.groupBy(x).pivot(y, wanted).agg(F.avg(value)).na.fill(0.0)


def health(df: DataFrame, error_rate: str = "error_rate") -> DataFrame:
    """Status and issues per sample. A later rule overwrites an earlier, more severe one;
    ``max_severity`` keeps the worst."""
    rules = [
        (F.col("cpu_percent") > fixed.CPU_LIMIT, "warning", "High CPU usage"),
        (F.col("memory_percent") > fixed.MEMORY_LIMIT, "warning", "High memory usage"),
        (F.col("disk_percent") > fixed.DISK_LIMIT, "critical", "High disk usage"),
        (F.col(error_rate) > fixed.ERROR_RATE_LIMIT, "warning", "High error rate"),
    ]
    return df.withColumns(_judge(rules))


def _judge(rules: list[tuple[Column, str, Column | str]]) -> dict[str, Column]:
    status = F.lit("healthy")
    for broken, severity, _ in rules:
        status = F.when(broken, severity).otherwise(status)
    issues = [F.when(broken, issue) for broken, _, issue in rules]
    worst = [F.when(broken, 2 if severity == "critical" else 1).otherwise(0) for broken, severity, _ in rules]
    rank = F.greatest(F.lit(0), *worst)
    return {
        "status": status,
        "issues": F.array_compact(F.array(*issues)),
        "max_severity": F.when(rank == 2, "critical").when(rank == 1, "warning").otherwise("healthy"),
    }


def rolling_load(metrics: DataFrame, keys: Sequence[str], tie: str, size: int = 60, segment_rows: int = 50_000):
    """Mean load over the last ``size`` samples up to each sample of a key."""
    aggregates = {
        "cpu_rolling": F.avg("cpu_percent"), "memory_rolling": F.avg("memory_percent"),
        "disk_rolling": F.avg("disk_percent"), "samples": F.count("*"),
    }
    order = [F.col("timestamp").asc(), F.col(tie).asc()]
    return trailing_window(metrics, order, size, aggregates, keys, segment_rows)


# --- cache -------------------------------------------------------------------


def hit_rate(reads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """hits / (hits + misses) in percent, 0 without reads."""
    hits, misses = F.count_if(F.col("outcome") == "hit"), F.count_if(F.col("outcome") == "miss")
    rate = F.when(hits + misses > 0, hits / F.nullif(hits + misses, F.lit(0)) * 100).otherwise(0.0)
    return reads.groupBy(*keys).agg(hits.alias("hits"), misses.alias("misses"), rate.alias("hit_rate"))


def cache_health(stats: DataFrame) -> DataFrame:
    """Rules over ``hit_rate`` and ``used_memory``; ``log_level`` follows the monitor's own floor."""
    def number(value: Column) -> Column:
        return F.call_function("format_number", value.cast("double"), F.lit("0.00"))

    rules = [
        (F.col("hit_rate") < fixed.CACHE_HIT_FLOOR, "warning",
         F.concat(F.lit("Low cache hit rate: "), number(F.col("hit_rate")), F.lit("%"))),
        (F.col("used_memory") > fixed.CACHE_MEMORY_LIMIT, "warning",
         F.concat(F.lit("High memory usage: "), number(F.col("used_memory") / 1_000_000), F.lit("MB"))),
    ]
    level = F.when(F.col("hit_rate") < fixed.CACHE_HIT_LOG_FLOOR, "WARNING").otherwise("INFO")
    judged = stats.withColumns(_judge(rules)).drop("max_severity")
    return judged.withColumn("log_level", level).withColumn("memory_usage_mb", F.col("used_memory") / 1_000_000)


# --- batches -----------------------------------------------------------------


def assign_batches(items: DataFrame, size: int = 100, key: str = "batch_type", tie: str = "item_id") -> DataFrame:
    """Number the items of a type in arrival order and cut them into batches of ``size``."""
    indexed = row_index(items, [F.col("created_at").asc(), F.col(tie).asc()], [key], "_index")
    return indexed.withColumn("batch_id", F.floor(F.col("_index") / size).cast("long")).drop("_index")


def batch_log(batched: DataFrame, key: str = "batch_type") -> DataFrame:
    """One row per batch: items, processing seconds and end time."""
    return batched.groupBy(key, "batch_id").agg(
        F.count("*").alias("items"), F.sum("seconds").alias("seconds"), F.max("created_at").alias("ended_at")
    )


def batch_statistics(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("batches_processed"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("total_processed"),
        _zero(F.avg("seconds")).alias("average_batch_time"),
    )


def running_batch_time(log: DataFrame, key: str = "batch_type") -> DataFrame:
    """Mean batch time up to and including each batch of a type."""
    totals = running_totals(
        log.withColumn("_one", F.lit(1)), [F.col("batch_id").asc()], {"seconds": "_seconds", "_one": "_batches"}, [key]
    )
    mean = F.col("_seconds") / F.col("_batches")
    return totals.withColumn("average_batch_time", mean).drop("_one", "_seconds", "_batches")


# --- logs --------------------------------------------------------------------


def request_durations(log: DataFrame) -> DataFrame:
    """Count, mean and 95th percentile of completed requests by method and path."""
    done = log.filter(F.col("message").startswith("Request completed") & F.col("duration").isNotNull())
    return _durations(done, ["method", "path"])


def function_durations(log: DataFrame) -> DataFrame:
    """Count, mean and 95th percentile by function and outcome."""
    return _durations(log.filter(F.col("function").isNotNull() & F.col("status").isNotNull()), ["function", "status"])


def _durations(log: DataFrame, keys: list[str]) -> DataFrame:
    basic = log.groupBy(*keys).agg(F.count("*").alias("calls"), F.avg("duration").alias("avg_duration"))
    return join_null_safe(basic, exact_percentiles(log, "duration", {"p95_duration": 0.95}, keys), keys, "left")
