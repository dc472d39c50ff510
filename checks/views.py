"""Views over the driver tables: tasks, metrics, logs, batches and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PAGES_PER_TASK = 10_000  # product pages that one task builds and reads


def spread(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Give CPU-heavy work all cores when the input has too few splits, and with ``task_rows`` no task many more rows than that.

    A corpus with that many splits is returned as it is, unshuffled.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        wanted = max(wanted, -(-df.count() // task_rows))
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= wanted else df.repartition(wanted)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as a UTC timestamp."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _status(event_type):
    return (
        F.when(event_type.isin("purchase", "click"), "completed")
        .when(event_type == "error", "failed")
        .when(event_type == "view", "processing")
        .otherwise("pending")
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """One task per event; it ends ``value`` seconds after its start once completed or failed."""
    status = _status(F.col("event_type"))
    ends = F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1_000_000).cast("bigint"))
    return events(spark, folder).select(
        F.col("event_id").alias("task_id"),
        F.concat(F.lit("https://site"), F.col("user_id") % 50, F.lit(".example/"), F.col("event_type")).alias("url"),
        status.alias("status"),
        F.col("user_id"),
        F.col("ts").alias("created_at"),
        F.when(status.isin("completed", "failed"), ends).alias("completed_at"),
        F.col("value").alias("duration"),
        F.col("value").alias("response_time"),
        F.when(status == "completed", F.col("props")).alias("result"),
        F.when(status == "failed", F.lit("HTTP 500")).alias("error"),
        F.when(F.col("event_type") == "view", "processing").otherwise("scraping").alias("type"),
        F.col("ts").alias("timestamp"),
    )


def task_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Request outcomes in the success/error vocabulary."""
    done = F.when(F.col("status") == "completed", "success").when(F.col("status") == "failed", "error")
    return tasks(spark, folder).withColumn("status", done.otherwise(F.col("status")))


def system_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One host sample per event."""
    return events(spark, folder).select(
        F.col("event_id").alias("sample_id"),
        (F.col("user_id") % 8).alias("host"),
        F.col("ts").alias("timestamp"),
        F.least(F.col("value"), F.lit(100.0)).alias("cpu_percent"),
        (F.col("event_id") % 100).cast("double").alias("memory_percent"),
        (F.col("user_id") % 100).cast("double").alias("disk_percent"),
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Structured log lines of requests and functions."""
    request = F.col("event_type").isin("click", "view", "purchase")
    method = F.element_at(F.array(F.lit("GET"), F.lit("POST"), F.lit("PUT")), (F.col("user_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/"), F.col("event_type"))
    text = F.when(request, F.concat(F.lit("Request completed: "), method, F.lit(" "), path))
    return events(spark, folder).select(
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.when(request, "http").otherwise("service").alias("logger"),
        text.otherwise(F.concat(F.lit("Function handle_"), F.col("event_type"), F.lit(" ended"))).alias("message"),
        F.when(~request, F.concat(F.lit("handle_"), F.col("event_type"))).alias("function"),
        F.when(request, method).alias("method"),
        F.when(request, path).alias("path"),
        F.col("value").alias("duration"),
        F.when(~request, F.when(F.col("event_type") == "error", "error").otherwise("success")).alias("status"),
    )


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """Store queries with their run time in milliseconds."""
    return events(spark, folder).select(
        F.col("event_id").alias("query_id"),
        F.col("event_type").alias("op"),
        F.concat(F.lit("store.t"), F.col("user_id") % 5).alias("ns"),
        F.floor(F.col("value") * 10).cast("bigint").alias("millis"),
        F.col("ts"),
        F.col("props").alias("query"),
        F.lit(None).cast("string").alias("planSummary"),
    )


def cache_reads(spark: SparkSession, folder: str) -> DataFrame:
    """Cache reads: clicks hit, views miss; other events read nothing."""
    kind = F.when(F.col("event_type") == "click", "hit").when(F.col("event_type") == "view", "miss")
    return events(spark, folder).select(
        F.hour("ts").alias("hour"), kind.alias("outcome"), F.floor(F.col("value") * 10_000).cast("bigint").alias("bytes")
    )


def batch_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items queued for batching, by type."""
    return events(spark, folder).select(
        F.col("event_id").alias("item_id"),
        F.col("event_type").alias("batch_type"),
        F.col("ts").alias("created_at"),
        (F.col("value") / 1000).alias("seconds"),
    )


def task_events(spark: SparkSession, folder: str) -> DataFrame:
    """State changes of tasks: a task is one user, every event sets its state."""
    return events(spark, folder).select(
        F.col("user_id").alias("task_id"),
        _status(F.col("event_type")).alias("status"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("sequence"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "HTTP 500").alias("error"),
    )


def part_links(spark: SparkSession, folder: str) -> DataFrame:
    """A link graph over the dense part keys: k links to 7k+1 and 3k+2 (mod n)."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    n = part.count()
    return part.select(
        F.col("k").alias("src"),
        F.posexplode(F.array((F.col("k") * 7 + 1) % n, (F.col("k") * 3 + 2) % n)).alias("link_seq", "dst"),
    )


def catalog_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A product page per part: metadata, media, tables and nested lists that ``pages`` lacks."""
    c = lambda name: F.col(name).cast("string")
    key, size, name, brand, kind = c("p_partkey"), c("p_size"), c("p_name"), c("p_brand"), c("p_type")
    kind_of_link = F.col("p_size") % 3
    link_text = F.when(kind_of_link == 0, " part guide").when(kind_of_link == 1, " click here for more").otherwise(" offer")
    pieces = [
        '<html lang="en"><head><title> ', name, ' </title><meta name="description" content="', kind, ' item">',
        '<meta name="Keywords" content="first"><meta name="keywords" content="', brand, '">',
        '<meta property="og:title" content="', name, '"><meta property="og:type" content="product">',
        '<meta name="twitter:card" content="summary"><meta name="twitter:site" content="', brand, '">',
        '<meta http-equiv="Content-Type" content="text/html; charset=iso-8859-1">',
        '<meta name="viewport" content="width=device-width"><meta name="robots" content="index">',
        '<link rel="canonical" href="https://shop.example/p/', key, '"><link rel="shortcut icon" href="/icons/', size, '.ico">',
        '<script type="application/ld+json">{"sku": ', key, ', "size": ', size, "}</script>",
        F.when(F.col("p_size") % 3 == 0, '<script type="application/ld+json">{broken</script>').otherwise(""),
        '</head><body><header><a href="/home">Home</a></header><h2>Offer ', brand, "</h2><h1>", name, " by ", brand, "</h1>",
        "<p>The ", name, " is a ", kind, " part of size ", size, " made by ", brand, ".</p><p>Short.</p>",
        "<table><tr><th>Brand</th><td>", brand, "</td></tr><tr></tr><tr><td>Size ", size, "</td><td></td></tr></table>",
        "<table><tr></tr></table><ul><li>", kind, "<ol><li>size ", size, "</li><li> </li></ol></li></ul>",
        '<img src="img/', key, '.jpg" alt="', name, '" width="', size, '"><img src="/abs.png" loading="lazy"><img src=" ">',
        '<video controls poster="/p.png"><source src="v/', key, '.mp4" type="video/mp4"><source src=""></video>',
        '<video autoplay></video><a href="../list?page=', size, '#x" rel="nofollow next">All parts</a>',
        '<a href="HTTPS://WWW.Vendor', size, '.example/a/" title="Vendor">Vendor guide</a>',
        '<a href="https://vendor', size, '.example/a">', name, link_text, '</a><a href="mailto:x@shop.example">Mail</a>',
        '<a href="#top">Top</a><footer>&copy; 2024 shop</footer></body></html>',
    ]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    url = F.concat(F.lit("https://www.Shop.example/items/"), key, F.lit(".html"))
    server = F.create_map(F.lit("server"), brand, F.lit("content-type"), F.lit("text/html"))
    return spread(table(spark, folder, "part"), PAGES_PER_TASK).select(
        F.col("p_partkey").alias("page_id"), url.alias("url"), server.alias("headers"), html.alias("html")
    )
