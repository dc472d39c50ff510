"""Filtered, ordered and paged listings, and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pagemill import fixed_values as fixed
from pagemill.operators.metrics import since


def collection_scan(df: DataFrame, where: Column, order: Sequence[Column] = ()) -> DataFrame:
    """Predicate plus sort; simple comparisons are pushed into the scan."""
    out = df.filter(where)
    return out.orderBy(*order) if order else out


def point_lookup(df: DataFrame, key: str, value, owner: str | None = None, owner_value=None) -> DataFrame:
    """The row of one key, optionally only for its owner."""
    out = df.filter(F.col(key) == F.lit(value))
    return out.filter(F.col(owner) == F.lit(owner_value)) if owner else out


def bulk_lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed in ``wanted``."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def page_of_tasks(
    tasks: DataFrame,
    user_id,
    page: int = 1,
    page_size: int = 20,
    status: str | None = None,
    after: tuple[datetime, int] | None = None,
) -> DataFrame:
    """A user's tasks, newest first, one page at a time.

    ``after`` is the (created_at, task_id) of the last row seen; paging by it needs
    no offset and stays cheap at any depth.
    """
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page must be at least 1 and page_size between 1 and 100")
    out = tasks.filter(F.col("user_id") == F.lit(user_id))
    if status:
        out = out.filter(F.col("status") == status)
    if after:
        created, task = F.lit(after[0]), F.lit(after[1])
        older = (F.col("created_at") < created) | ((F.col("created_at") == created) & (F.col("task_id") < task))
        return out.filter(older).orderBy(F.desc("created_at"), F.desc("task_id")).limit(page_size)
    return out.orderBy(F.desc("created_at"), F.desc("task_id")).offset((page - 1) * page_size).limit(page_size)


def system_history(metrics: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Load samples of the last ``hours`` in time order, missing values as 0.

    One row per sample: an array per series would gather them all in one task.
    """
    recent = since(metrics, "timestamp", as_of, hours=hours)
    series = {"cpu": "cpu_percent", "memory": "memory_percent", "disk": "disk_percent"}
    keys = [c for c in ("host", "sample_id") if c in metrics.columns]
    columns = [F.coalesce(column, F.lit(0.0)).alias(name) for name, column in series.items()]
    return recent.select(*keys, "timestamp", *columns).orderBy("timestamp", *keys)


def _default(df: DataFrame, name: str, value: Column) -> Column:
    return (F.coalesce(F.col(name), value) if name in df.columns else value).alias(name)


def processed_listing(processed: DataFrame, user_id) -> DataFrame:
    """A user's processed documents, newest first, absent fields as their defaults."""
    texts, none, zero = F.array().cast("array<string>"), F.lit(""), F.lit(0).cast("long")
    mine = processed.filter(F.col("user_id") == F.lit(user_id)).orderBy(F.desc("created_at"), F.desc("id"))
    processed_at = F.coalesce(F.col("processed_at").cast("string"), none) if "processed_at" in processed.columns else none
    return mine.select(
        "id", _default(processed, "url", none), _default(processed, "title", none),
        _default(processed, "headings", texts), _default(processed, "paragraphs", texts),
        _default(processed, "meta", F.create_map().cast("map<string,string>")),
        processed_at.alias("processed_at"),
        *[_default(processed, c, zero) for c in ("content_length", "headings_count", "paragraphs_count")],
    )


def processing_tasks(tasks: DataFrame, user_id) -> DataFrame:
    """A user's processing tasks, newest first."""
    mine = tasks.filter((F.col("user_id") == F.lit(user_id)) & (F.col("type") == "processing"))
    data_id = _default(tasks, "data_id", F.lit(""))
    return mine.orderBy(F.desc("created_at"), F.desc("task_id")).select(
        F.col("task_id").alias("id"), "status", data_id, "created_at", "result", "error"
    )


def export_listing(exports: DataFrame, user_id) -> DataFrame:
    """A user's exports, newest first."""
    mine = exports.filter(F.col("user_id") == F.lit(user_id)).orderBy(F.desc("created_at"), F.desc("id"))
    nothing = F.lit(None).cast("string")
    return mine.select(
        "id", "format", "status", "record_count", _default(exports, "file_path", nothing), "created_at",
        _default(exports, "error", nothing),
    )


def slow_queries(log: DataFrame, limit: int = 10, tie: str = "query_id") -> DataFrame:
    """The slowest queries over the threshold."""
    slow = log.filter(F.col("millis") > fixed.SLOW_QUERY_MILLIS)
    return slow.orderBy(F.desc("millis"), tie).limit(limit).select(
        F.col("op").alias("operation"), F.col("ns").alias("collection"), F.col("millis").alias("duration_ms"),
        F.col("ts").alias("timestamp"), "query", "planSummary",
    )


def result_lookup(requests: DataFrame, tasks: DataFrame, owner: str | None = None) -> DataFrame:
    """For every requested task: its result, or why there is none."""
    on = ["task_id", owner] if owner else ["task_id"]
    known = tasks.select(*on, F.col("status").alias("_status"), F.col("result").alias("_result"))
    joined = requests.join(known, on, "left")
    done = F.col("_status") == "completed"
    outcome = F.when(F.col("_status").isNull(), "Task not found").when(~done, "Task not completed yet").otherwise("ok")
    return joined.select(*on, outcome.alias("outcome"), F.when(done, F.col("_result")).alias("result"))
