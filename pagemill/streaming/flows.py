"""Structured Streaming forms: rollups, alerts, task state, deduplication, ingest.

Every flow takes a streaming DataFrame; ``run_available`` drives one over the input
there is and stops. Output and checkpoints go to folders, never to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from pagemill.operators import documents as docs, metrics as mx
from pagemill.plans.stored import delete_folder, exists, fresh_path, list_names, materialize
from pagemill.sources import readers
from pagemill.streaming import keyed


def read_folder(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder (or glob) of files as a stream, optionally a bounded number per micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process all available input into Parquet at ``path`` and return what was written."""
    spark = stream.sparkSession
    checkpoint = checkpoint or fresh_path(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.outputMode(mode).format("parquet").option("path", path).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None):
    """Process all available input with ``handle(batch, batch_id)``."""
    checkpoint = checkpoint or fresh_path(stream.sparkSession, "stream")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.outputMode(mode).foreachBatch(handle).start().awaitTermination()


# --- metrics -----------------------------------------------------------------


def metric_rollup(samples: DataFrame, width: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Mean and peak load per host and tumbling window.

    Partial aggregation keeps a busy host's rows on the map side; one row per host and
    window reaches the state store.
    """
    load = ["cpu_percent", "memory_percent", "disk_percent"]
    return (
        samples.withWatermark("timestamp", late)
        .groupBy("host", F.window("timestamp", width))
        .agg(
            *[F.avg(c).alias(c.replace("percent", "avg")) for c in load],
            *[F.max(c).alias(c.replace("percent", "peak")) for c in load],
            F.count("*").alias("samples"),
        )
        .withColumn("window_start", F.col("window.start"))
        .drop("window")
    )


def alerts(samples: DataFrame) -> DataFrame:
    """Samples that break a load rule. Stateless: every micro-batch is a projection."""
    judged = mx.health(samples.withColumn("error_rate", F.lit(0.0)))
    return judged.filter(F.size("issues") > 0).drop("error_rate")


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Keyed state lives in RocksDB, which holds more keys than memory does; other queries of the session keep their store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Keyed:
    """A stateful flow whose state is Spark's: kept below ``checkpoint``, read by the state reader.

    ``run`` takes what input there is and stops; a later ``run`` with the same checkpoint, by whatever session, goes on where the last one
    stopped, and a batch that is tried again leaves no trace of the first try. ``changes`` names a folder for the rows of changed
    keys, one folder per micro-batch. With ``forget_after`` and ``late`` (intervals) event-time timers drop what is no longer needed.
    """

    def __init__(self, spark: SparkSession, checkpoint: str | None = None, forget_after: str | None = None, late: str = "1 minute"):
        self.spark, self.checkpoint, self.late = spark, checkpoint or fresh_path(spark, "keyed"), late
        self.forget_after = forget_after and int(spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {forget_after})").first()[0])

    def _grouped(self, rows: DataFrame, keys: Sequence[str], processor, schema) -> DataFrame:
        if self.forget_after:
            # The processor reads event times as numbers; the watermark follows the time itself.
            rows = rows.withColumn("_watermark", F.timestamp_millis(keyed.EVENT_TIME)).withWatermark("_watermark", self.late)
        mode = "EventTime" if self.forget_after else "None"
        return rows.groupBy(*keys).transformWithState(processor, schema, "update", mode)

    def run(self, stream: DataFrame, changes: str | None = None) -> None:
        def store(batch: DataFrame, batch_id: int) -> None:
            if changes:
                batch.write.mode("overwrite").parquet(f"{changes}/batch={batch_id}")
            else:
                batch.write.format("noop").mode("overwrite").save()

        with _state_store(self.spark):
            run_batches(self.updates(stream), store, "update", self.checkpoint)

    def _state(self, variable: str, schema: T.StructType) -> DataFrame:
        """A state variable as rows; none where no batch has run."""
        if not exists(self.spark, f"{self.checkpoint}/commits/0"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format("statestore").option("stateVarName", variable).load(self.checkpoint)


class RecentRows(_Keyed):
    """The newest ``size`` rows per key of a stream, in list state.

    Every task cuts its rows to the newest per key before the shuffle, so a busy key costs its buffer and no more. Times travel as
    microseconds. Columns may be numbers, strings, booleans and timestamps. With ``forget_after`` the first column of ``order``
    is a timestamp, and a key that gets nothing newer for that long is dropped.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str], order: Sequence[str], size: int, schema: T.StructType, **options):
        super().__init__(spark, **options)
        self.keys, self.order, self.size, self.schema = list(keys), list(order), size, schema
        self.times = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampType)]
        fields = [T.StructField(f.name, T.LongType() if f.name in self.times else f.dataType) for f in schema.fields]
        self.stored = T.StructType(fields)

    def newest(self, df: DataFrame) -> DataFrame:
        """The same over a table."""
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order]))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= self.size).drop("_rank")

    def updates(self, stream: DataFrame) -> DataFrame:
        """Streaming: the newest rows of every key that changed."""
        columns = [F.unix_micros(c).alias(c) if c in self.times else F.col(c) for c in self.schema.names]
        if self.forget_after:
            columns.append(F.unix_millis(self.order[0]).alias(keyed.EVENT_TIME))
        rows = stream.select(columns)
        keys, order, size = self.keys, self.order, self.size
        cut = rows.mapInArrow(keyed.reduced(lambda table: keyed.newest(table, keys, order, size)), rows.schema)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.stored.fields)
        found = self._grouped(cut, keys, keyed.Newest(self.stored.names, ddl, order, size, self.forget_after), self.stored)
        return found.select(self._plain(""))

    def _plain(self, prefix: str) -> list[Column]:
        return [F.timestamp_micros(prefix + c).alias(c) if c in self.times else F.col(prefix + c).alias(c) for c in self.schema.names]

    def table(self) -> DataFrame:
        rows = self._state("rows", T.StructType([T.StructField("list_element", self.stored)]))
        return rows.select(self._plain("list_element."))


# --- tasks -------------------------------------------------------------------


class TaskStates(_Keyed):
    """Current state per task from a stream of state changes, in value state.

    Every task of Spark first reduces its changes to one partial state per key; the result equals ``lifecycle.latest_state`` over all
    changes. With ``forget_after`` a task that has ended and gets no change for that long is dropped.
    """

    def updates(self, stream: DataFrame) -> DataFrame:
        """Streaming: the state of every task that changed."""
        failed = (F.col("status") == "failed") & F.col("error").isNotNull()
        at, sequence = F.unix_micros("updated_at"), F.col("sequence").cast("long")
        columns = [
            "task_id", at.alias("at"), sequence.alias("sequence"), F.col("status"), F.when((F.col("status") == "completed") | failed, at).alias("completed_at"),
            F.when(failed, at).alias("failed_at"), F.when(failed, sequence).alias("failed_sequence"), F.when(failed, F.col("error")).alias("error"),
            F.lit(1).cast("long").alias("changes"),
        ]
        if self.forget_after:
            columns.append(F.unix_millis("updated_at").alias(keyed.EVENT_TIME))
        rows = stream.select(columns)
        parts = rows.mapInArrow(keyed.reduced(keyed.task_partials), rows.schema)
        kind = rows.schema["task_id"].dataType.simpleString()
        return self._grouped(parts, ["task_id"], keyed.LatestState(self.forget_after), f"task_id {kind}, {keyed.TASK_STATE}")

    def table(self, kind: str = "string") -> DataFrame:
        schema = T.StructType.fromDDL(f"key struct<task_id: {kind}>, value struct<{keyed.TASK_STATE.replace(' ', ': ').replace(',:', ',')}>")
        status = F.col("value.status")
        progress = F.when(status == "processing", 10).when(status == "completed", 100).otherwise(0)
        return self._state("state", schema).select(
            "key.task_id", status.alias("status"), F.timestamp_micros("value.at").alias("updated_at"),
            F.timestamp_micros("value.completed_at").alias("completed_at"), "value.error", "value.changes", progress.cast("long").alias("progress"),
        )


# --- batches -----------------------------------------------------------------


def micro_batches(items: DataFrame, handle: Callable[[DataFrame, int], None], log_path: str, size: int = 100) -> None:
    """Cut each micro-batch into per-type batches of ``size``, hand them on, log one row per batch.

    A trigger takes what has arrived, so a short remainder is flushed with it: the
    count-or-time rule of a batch queue.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        cut = mx.assign_batches(batch, size)
        handle(cut, batch_id)
        log = mx.batch_log(cut).withColumn("trigger", F.lit(batch_id).cast("long"))
        log.write.mode("overwrite").parquet(f"{log_path}/trigger_id={batch_id}")

    run_batches(items, process)


# --- documents ---------------------------------------------------------------


class SeenTexts:
    """Duplicate flags over an unbounded stream whose memory never expires.

    The hashes of texts seen so far lie in buckets, by batch. In front of them stands a Bloom filter: ``words`` words of 64 bits, of
    which a hash owns four bits of one. A batch is reduced to one row per hash and meets the filter's words first; only hashes whose bits are all
    set are looked up, in their buckets alone, and compared exactly. So a batch of new texts reads no stored hash, and one with few old texts
    reads few buckets. Beyond about eight hashes a word the filter lets more through; flags stay exact.

    Hashes and filter of a batch lie in folders of its id: a retried batch replaces its own, and reads only earlier ones.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, key: str, folder: str | None = None, words: int = 1 << 20):
        self.spark, self.key, self.folder, self.words = spark, key, folder or fresh_path(spark, "seen"), words

    def _placed(self, hashes: DataFrame) -> DataFrame:
        """With each hash's ``bucket``, its ``word`` of the filter, and the ``mask`` of its bits there."""
        spot, bits = F.xxhash64("text_hash"), F.xxhash64("text_hash", F.lit(1))
        mask = reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)])
        return hashes.select(
            "*", F.pmod(spot, F.lit(self.BUCKETS)).cast("int").alias("bucket"), F.pmod(F.shiftrightunsigned(spot, 8), F.lit(self.words)).alias("word"), mask.alias("mask")
        )

    def _filter(self, below: int) -> DataFrame | None:
        """The filter before batch ``below``: (``word``, ``bits``) where any bit is set."""
        numbers = [int(n.split("=")[1]) for n in list_names(self.spark, f"{self.folder}/filter") if n.startswith("batch=")]
        earlier = [n for n in numbers if n < below]
        return self.spark.read.schema("word long, bits long").parquet(f"{self.folder}/filter/batch={max(earlier)}") if earlier else None

    def _known(self, hashed: DataFrame, batch_id: int) -> DataFrame | None:
        """First keys of the batch's hashes that an earlier batch has stored; None where the filter rules all of them out."""
        words = self._filter(batch_id)
        if words is None:
            return None
        probes = self._placed(hashed.select("text_hash").distinct())
        possible = probes.join(words, "word").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("text_hash", "bucket")
        possible = materialize(possible, "possible")
        buckets = possible.agg(F.sort_array(F.collect_set("bucket"))).first()[0]  # at most BUCKETS numbers
        if not buckets:
            return None
        kind = hashed.schema[self.key].dataType.simpleString()
        schema = f"text_hash string, first_key {kind}, first_seen {kind}, batch long, bucket int"
        stored = self.spark.read.schema(schema).parquet(f"{self.folder}/hashes").filter((F.col("batch") < batch_id) & F.col("bucket").isin(buckets))
        return stored.join(possible.select("text_hash"), "text_hash").select("text_hash", "first_key", "first_seen")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        hashed = docs.hashed_texts(batch, self.key)
        path = f"{self.folder}/marks/batch={batch_id}"
        docs.mark_hashed(hashed, self.key, self._known(hashed, batch_id)).write.mode("overwrite").parquet(path)
        fresh = self.spark.read.parquet(path).filter(~F.col("is_duplicate"))
        fresh = self._placed(fresh.select("text_hash", F.col(self.key).alias("first_key"), F.col(self.key).alias("first_seen")))
        # One file per bucket and batch, whatever the number of tasks.
        by_bucket = fresh.select("text_hash", "first_key", "first_seen", "bucket").repartition("bucket")
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/hashes/batch={batch_id}")
        words, before = fresh.select("word", F.col("mask").alias("bits")), self._filter(batch_id)
        words = words.union(before) if before is not None else words
        words.groupBy("word").agg(F.bit_or("bits").alias("bits")).write.mode("overwrite").parquet(f"{self.folder}/filter/batch={batch_id}")
        delete_folder(self.spark, f"{self.folder}/filter/batch={batch_id - 2}")  # the last batch may be tried again, and reads the one before

    def table(self) -> DataFrame:
        """The flags of every batch so far, whichever session wrote them."""
        return self.spark.read.parquet(f"{self.folder}/marks").drop("batch")


def ingest(lines: DataFrame, clean_path: str, rejected_path: str, as_of: Column | None = None) -> None:
    """Submitted JSON lines -> checked -> cleaned Parquet; what fails goes to ``rejected_path``.

    Each micro-batch writes to a folder of its own id, so a retried batch replaces its
    own output and nothing is written twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        good, bad = readers.good_and_bad(readers.submissions(batch))
        cleaned = docs.clean_record(good, as_of=as_of).withColumn("status", F.lit("completed"))
        cleaned.write.mode("overwrite").parquet(f"{clean_path}/batch={batch_id}")
        bad.withColumn("status", F.lit("failed")).write.mode("overwrite").parquet(f"{rejected_path}/batch={batch_id}")

    run_batches(lines, store)
