"""Writers and the export job."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from pagemill import schemas
from pagemill.functions.common import unnest
from pagemill.plans.stored import delete_folder, materialize

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def flat_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, NESTED)]
    return df.withColumns({name: F.to_json(name) for name in nested})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    """Header line, nested values as JSON text."""
    flat_text(df).write.mode(mode).options(header=True, escape='"', **options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> None:
    """JSON lines in UTF-8, non-ASCII characters as they are."""
    df.write.mode(mode).options(ignoreNullFields=False, **options).json(path)


STATUS_ORDER = ["pending", "processing", "completed", "failed"]
WRITERS = {"csv": write_csv, "json": write_json}


def compressed_json(df: DataFrame, path: str, codec: str = "gzip") -> None:
    """JSON lines, compressed as the caller says (``none`` for plain files); the input is computed once."""
    write_json(df, path, compression=codec)


def gather(wanted: DataFrame, processed: DataFrame) -> DataFrame:
    """Items of the requested documents in request order: (position, item_no, item fields).

    ``wanted`` has (position, id). Ids without processed data give no rows; an id asked
    for twice gives its items twice.
    """
    joined = wanted.join(processed.select("id", "data"), "id")
    return unnest(joined, ["position"], "data", "item", "item_no").select("position", "item_no", "item.*")


def export(
    wanted: DataFrame, processed: DataFrame, fmt: str, user_id: str, folder: str, as_of: datetime | None = None
) -> DataFrame:
    """Write the requested items and return the manifest row.

    The rows are counted while they are written. An unknown format or a failed write
    gives a ``failed`` row instead of an exception.
    """
    spark = processed.sparkSession
    export_id = uuid.uuid4().hex
    path = f"{folder.rstrip('/')}/export_{export_id}"
    seen, error, rows = Observation(), None, 0
    if fmt not in WRITERS:
        error = f"Unsupported format: {fmt}"
    else:
        items = gather(wanted, processed)
        try:
            # Sorting samples its input first: the items are computed once and kept for both passes.
            items = materialize(items, "export-items").orderBy("position", "item_no").drop("position", "item_no")
            WRITERS[fmt](items.observe(seen, F.count(F.lit(1)).alias("rows")), path)
            rows = seen.get["rows"]
        except Exception as problem:  # reported in the manifest, as any export outcome is
            error = f"{type(problem).__name__}: {problem}"
            delete_folder(spark, path)
    row = (
        export_id, str(user_id), fmt, rows, None if error else path, as_of or datetime.now(timezone.utc),
        "failed" if error else "completed", error,
    )
    return spark.createDataFrame([row], schemas.EXPORT)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a manifest, metric or status table."""
    df.write.mode("append").parquet(path)


def status_events(documents: DataFrame, status: str, at, error=None) -> DataFrame:
    """Status changes to append; the newest per id is the current state."""
    message = error if error is not None else F.lit(None).cast("string")
    return documents.select(
        F.col("id").cast("string").alias("id"), F.lit(status).alias("processing_status"), at.alias("updated_at"), message.alias("error")
    )


def current_status(events: DataFrame) -> DataFrame:
    """The newest status per id; an earlier error stays until overwritten.

    Of equal times the status further along wins (pending, processing, completed, failed, others by name), and of
    equal errors' times the last error by text.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.coalesce("processing_status", F.lit("")))
    newest = F.max(F.struct("updated_at", F.when(place == 0, len(STATUS_ORDER) + 1).otherwise(place).alias("place"), "processing_status"))
    failed = F.max(F.when(F.col("error").isNotNull(), F.struct("updated_at", "error")))
    grouped = events.groupBy("id").agg(newest.alias("_newest"), failed.alias("_failed"))
    return grouped.select(
        "id", F.col("_newest.processing_status").alias("processing_status"), F.col("_newest.updated_at").alias("updated_at"),
        F.col("_failed.error").alias("error"),
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EXPORT).parquet(path)
