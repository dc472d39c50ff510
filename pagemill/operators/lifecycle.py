"""Retention, key checks, table statistics and current task state."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pagemill import fixed_values as fixed
from pagemill.plans.stored import delete_folder, materialize


def expired_before(column: str, as_of: datetime, days: int) -> Column:
    return F.col(column) < F.lit(as_of - timedelta(days=days))


def expired_failure(as_of: datetime, days: int) -> Column:
    """Failed tasks older than ``days``; other states never expire."""
    return (F.col("status") == "failed") & expired_before("created_at", as_of, days)


def retain(df: DataFrame, expired: Column) -> DataFrame:
    """The rows that stay; a null condition keeps the row."""
    return df.filter(~F.coalesce(expired, F.lit(False)))


def retention_counts(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Deleted and kept rows per table, one narrow pass each."""
    parts = []
    for name, (df, expired) in tables.items():
        gone = F.coalesce(expired, F.lit(False))
        parts.append(
            df.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept")).withColumn("table_name", F.lit(name))
        )
    return reduce(DataFrame.unionByName, parts)


def expire(spark: SparkSession, folder: str, expired: Column) -> None:
    """Delete the rows of a table laid out by ``day`` for which ``expired`` holds.

    One pass over the columns of the condition counts each day. Days without a row to keep are dropped as folders;
    days that the rule splits are rewritten, from a copy stored before anything is replaced; others are not touched.
    """
    table = spark.read.parquet(folder)
    gone = F.coalesce(expired, F.lit(False))
    counts = table.groupBy("day").agg(F.count_if(gone).alias("gone"), F.count("*").alias("rows"))
    hit = counts.filter("gone > 0").select(F.col("day").cast("string").alias("day"), "gone", "rows").collect()  # a row per day
    split = [r["day"] for r in hit if r["gone"] < r["rows"]]
    if split:
        chosen = F.coalesce(F.col("day").cast("string"), F.lit("")).isin([d or "" for d in split])
        kept = materialize(table.filter(chosen & ~gone), "kept")
        writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
        writer.parquet(folder)
    for r in hit:
        if r["gone"] == r["rows"]:
            delete_folder(spark, f"{folder.rstrip('/')}/day={r['day'] or '__HIVE_DEFAULT_PARTITION__'}")


def unique_violations(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Key values that occur more than once."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key_value")).agg(
        F.count("*").alias("rows")
    )
    return counts.filter(F.col("rows") > 1).withColumn("key_name", F.lit(name or key))


FIXED_BYTES = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8,
    T.TimestampType: 8, T.TimestampNTZType: 8,
}


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value whatever engine or file holds it: numbers and times by their width, texts in UTF-8, nested values by their parts; null has none."""
    if type(kind) in FIXED_BYTES:
        return F.when(value.isNotNull(), FIXED_BYTES[type(kind)]).otherwise(0).cast("long")
    none = F.lit(0).cast("long")
    if isinstance(kind, T.DecimalType):
        return F.when(value.isNotNull(), 8 if kind.precision <= 18 else 16).otherwise(0).cast("long")
    if isinstance(kind, T.ArrayType):
        if type(kind.elementType) in FIXED_BYTES:
            filled = F.size(F.array_compact(value)).cast("long")
            return F.when(value.isNotNull(), filled * FIXED_BYTES[type(kind.elementType)]).otherwise(none)
        return F.coalesce(F.aggregate(value, none, lambda total, item: total + value_bytes(item, kind.elementType)), none)
    if isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        return value_bytes(F.map_keys(value), keys) + value_bytes(F.map_values(value), values)
    if isinstance(kind, T.StructType):
        return reduce(Column.__add__, [value_bytes(value[f.name], f.dataType) for f in kind.fields], none)
    return F.coalesce(F.octet_length(value.cast("string") if not isinstance(kind, T.BinaryType) else value), F.lit(0)).cast("long")


def json_bytes(df: DataFrame) -> Column:
    """Bytes of a row as compact JSON."""
    return F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values."""
    return reduce(Column.__add__, [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])


def table_statistics(tables: dict[str, DataFrame], size: Callable[[DataFrame], Column] = json_bytes) -> DataFrame:
    """Rows, bytes (as ``json_bytes`` or ``row_bytes`` count them) and mean row bytes per table."""
    parts = []
    for name, df in tables.items():
        parts.append(df.select(size(df).alias("_b")).agg(F.count("*").alias("rows"), F.sum("_b").alias("bytes")).select(
            F.lit(name).alias("table_name"), "rows", F.coalesce("bytes", F.lit(0)).alias("bytes")
        ))
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("mean_row_bytes", F.when(F.col("rows") > 0, F.col("bytes") / F.nullif("rows", F.lit(0))).otherwise(0.0))


def store_totals(statistics: DataFrame) -> DataFrame:
    totals = statistics.agg(
        F.sum("rows").alias("total_documents"), F.sum("bytes").alias("total_size_bytes"),
        F.count("*").alias("collections"),
    )
    mean = F.when(F.col("total_documents") > 0, F.col("total_size_bytes") / F.nullif("total_documents", F.lit(0)))
    return totals.withColumn("average_document_size", F.coalesce(mean, F.lit(0.0)))


def advice(metrics: DataFrame) -> DataFrame:
    """Recommendations from ``total_size_bytes``, ``slow_queries``, ``index_size`` and ``database_size``."""
    index_heavy = F.col("index_size") > F.col("database_size") * fixed.INDEX_SHARE
    rules = [
        F.when(F.col("total_size_bytes") > fixed.STORE_SIZE_LIMIT, fixed.ADVICE_ARCHIVE),
        F.when(F.col("slow_queries") > fixed.SLOW_QUERY_COUNT, fixed.ADVICE_SLOW),
        F.when(index_heavy, fixed.ADVICE_INDEX),
    ]
    return metrics.withColumn("recommendations", F.array_compact(F.array(*rules)))


def write_layout(
    df: DataFrame, folder: str, time: str = "created_at", sort: Sequence[str] = ("user_id", "created_at")
) -> None:
    """Store a table for its access paths: a directory per day, files sorted by user and time.

    Rows are range-partitioned by day and sort key, so files are even and a day or user
    that holds most rows spreads over many tasks.
    """
    dated = df.withColumn("day", F.to_date(time))
    dated = dated.repartitionByRange("day", *sort).sortWithinPartitions("day", *sort)
    dated.write.mode("overwrite").partitionBy("day").parquet(folder)


def latest_state(events: DataFrame) -> DataFrame:
    """Current state of each task from its state changes.

    ``completed``, or ``failed`` with an error, sets the completion time; the last
    error seen stays, as later updates do not clear it.
    """
    order = F.struct("updated_at", "sequence")
    ends = (F.col("status") == "completed") | ((F.col("status") == "failed") & F.col("error").isNotNull())
    failed = (F.col("status") == "failed") & F.col("error").isNotNull()
    progress = F.when(F.col("status") == "processing", 10).when(F.col("status") == "completed", 100).otherwise(0)
    grouped = events.groupBy("task_id").agg(
        F.max_by("status", order).alias("status"),
        F.max("updated_at").alias("updated_at"),
        F.max(F.when(ends, F.col("updated_at"))).alias("completed_at"),
        F.max_by("error", F.when(failed, order)).alias("error"),
        F.count("*").alias("changes"),
    )
    return grouped.withColumn("progress", progress.cast("long"))
