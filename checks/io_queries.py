"""Sources, sinks and streams: data derived from the tables goes out and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import insight_queries as iq, metric_queries as mq, page_queries as pq, text_queries as tq
from checks.metric_queries import SQL_LOG, micros, r, rounded
from checks.page_queries import SQL_PAGES, SQL_PARAS
from checks.text_queries import SPACE, SQL_SENTENCES, sql_clean
from pagemill import schemas
from pagemill.functions import text as tx
from pagemill.operators import documents as docs, lifecycle as life, listing, metrics as mx
from pagemill.plans.stored import fresh_path
from checks import views
from pagemill.sources import files, readers, writers
from pagemill.streaming import flows

KINDS = 6  # ways a submission can be good or bad


def page_scan(spark, folder):
    corpus = readers.page_corpus(spark, f"{folder}/pages.parquet")
    return corpus.select("page_id", "url", F.length("html").cast("long").alias("html_chars"))


def html_file_scan(spark, folder):
    """Every page as an HTML file of its own, read back whole."""
    path = fresh_path(spark, "html")
    name = F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(".html"))
    files.write_files(views.table(spark, folder, "pages").select(name.alias("file"), F.col("html").alias("value")), path)
    out = readers.page_corpus(spark, path, html_files=True)
    page = F.regexp_extract("url", "page_id=([0-9]+)", 1).cast("long")
    return out.select(page.alias("page_id"), F.md5(F.regexp_replace("html", "\n$", "")).alias("html_md5"))


def crawl_json_multiline(spark, folder):
    """Crawl results pretty-printed, one object per file."""
    pages = iq.crawl_records(spark, folder, "basic")
    name = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(".json"))
    page = F.struct("url", "title", "content_length")
    text = F.to_json(F.struct(F.col("url").alias("base_url"), F.lit(1).alias("pages_scraped"), F.array(page).alias("pages")), {"pretty": "true"})
    path = fresh_path(spark, "crawl-objects")
    files.write_files(pages.select(name.alias("file"), text.alias("value")), path)
    out = readers.crawl_pages(readers.crawl_results(spark, path, folders=True))
    return out.select("base_url", "title", "content_length")


def crawl_json_scan(spark, folder):
    """Crawl results of one page each, written as JSON and read back through the schema."""
    pages = iq.crawl_records(spark, folder, "basic").select(
        "url", F.struct("url", "title", "headings", "paragraphs", "links", "images", "meta", "content_length",
                        "headings_count", "paragraphs_count", "links_count", "images_count").alias("page"),
    )
    path = fresh_path(spark, "crawl-json")
    pages.select(F.col("url").alias("base_url"), F.lit(1).alias("pages_scraped"), F.array("page").alias("pages")).write.json(path)
    out = readers.crawl_pages(readers.crawl_results(spark, path, lines=True))
    return out.groupBy("title").agg(
        F.count("*").alias("pages"), F.sum("content_length").alias("content_length"),
        F.sum(F.size("paragraphs")).alias("paragraphs"),
    )


def processed(spark, folder):
    """Documents as processed data: one cleaned item per document."""
    sub = tq.documents(spark, folder).withColumn("headings", tx.sentences(F.col("text"))).select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("https://docs.example/"), F.col("doc_id")).alias("url"),
        F.get("headings", F.lit(0)).alias("title"),
        "headings", F.split("text", "\n").alias("paragraphs"), "text",
    )
    cleaned = docs.clean_record(sub, content="text")
    item = F.struct("url", "title", "headings", "paragraphs", "content_length", "headings_count", "paragraphs_count")
    return cleaned.select("id", F.array(item).alias("data"))


def wanted(spark, folder):
    """Ids to export, highest first; some have no document."""
    return views.table(spark, folder, "labels").select(
        (-F.col("doc_id")).alias("position"), (F.col("doc_id") * 2).cast("string").alias("id")
    )


def export_rows(spark, folder):
    items = writers.gather(wanted(spark, folder), processed(spark, folder))
    return items.select("position", "url", "title", F.array_join("headings", "|").alias("headings"), "content_length")


def csv_export(spark, folder):
    path = fresh_path(spark, "csv")
    writers.write_csv(writers.gather(wanted(spark, folder), processed(spark, folder)), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.col("position").cast("long").alias("position"), "url", F.coalesce("title", F.lit("")).alias("title"), "headings")


def json_export(spark, folder):
    path = fresh_path(spark, "json")
    writers.write_json(writers.gather(wanted(spark, folder), processed(spark, folder)), path)
    back = spark.read.schema("position bigint, url string, title string, headings array<string>").json(path)
    return back.select("position", "url", "title", F.to_json("headings").alias("headings"))


def export_manifest(spark, folder):
    """Three export jobs appended to one manifest; the unsupported format fails."""
    data, path, out = processed(spark, folder), fresh_path(spark, "manifest"), fresh_path(spark, "exports")
    for fmt in ("csv", "json", "yaml"):
        writers.append_rows(writers.export(wanted(spark, folder), data, fmt, "7", out), path)
    return writers.read_manifest(spark, path).select("user_id", "format", "record_count", "status", "error")


def metric_append(spark, folder):
    """Task metrics with arbitrary keys appended and read back."""
    metrics = F.map_from_arrays(
        F.array(F.lit("status"), F.lit("duration"), F.lit("user"), F.lit("props")),
        F.array(F.col("event_type"), F.col("value").cast("string"), F.col("user_id").cast("string"), F.col("props")),
    )
    rows = views.events(spark, folder).select(readers.metric_entry(F.col("event_id"), metrics, F.col("ts")).alias("m")).select("m.*")
    path = fresh_path(spark, "metrics")
    writers.append_rows(rows, path)
    back = spark.read.schema(schemas.TASK_METRIC).parquet(path)
    return back.select("task_id", "status", "duration", F.col("extra")["user"].alias("user"), F.size("extra").cast("long").alias("extras"))


def log_scan(spark, folder):
    path = fresh_path(spark, "log")
    views.request_log(spark, folder).write.json(path)
    out = mx.request_durations(readers.structured_log(spark, path))
    return rounded(out, "avg_duration", "p95_duration")


def compressed_output(spark, folder):
    """Tasks of every status, compressed because they are many."""
    path = fresh_path(spark, "gzip")
    writers.compressed_json(views.tasks(spark, folder).select("task_id", "status", "duration"), path)
    zipped = F.input_file_name().endswith(".json.gz")
    back = spark.read.schema("task_id bigint, status string, duration double").json(path).withColumn("gzipped", zipped)
    return back.groupBy("status", "gzipped").agg(F.count("*").alias("rows"))


def submission_lines(spark, folder):
    """Documents as submitted JSON: by id whole, cut short, without title, without lists, with a bad URL, as an array."""
    url = F.when(F.col("doc_id") % KINDS == 4, F.lit("not-a-valid-url")).otherwise(F.concat(F.lit("https://docs.example/"), F.col("doc_id")))
    title = F.when(F.col("doc_id") % KINDS != 2, F.get(tx.sentences(F.col("text")), F.lit(0)))
    lists = F.when(F.col("doc_id") % KINDS != 3, tx.sentences(F.col("text")))
    doc = F.to_json(F.struct(url.alias("url"), title.alias("title"), lists.alias("headings"), F.split("text", "\n").alias("paragraphs")))
    line = F.when(F.col("doc_id") % KINDS == 1, F.substring(doc, 1, 20)).when(F.col("doc_id") % KINDS == 5, F.lit("[1, 2]")).otherwise(doc)
    return tq.documents(spark, folder).select(F.col("doc_id").alias("id"), line.alias("value"))


def submissions(spark, folder):
    out = readers.submissions(submission_lines(spark, folder))
    return out.select("id", F.coalesce("problem", F.lit("")).alias("problem"))


def status_writeback(spark, folder):
    """Every document starts processing; those of odd id fail, the others complete."""
    base = views.table(spark, folder, "documents").select(F.col("doc_id").alias("id"))
    at = lambda day: F.timestamp_micros(F.lit(day * 86_400_000_000))
    path = fresh_path(spark, "status")
    writers.append_rows(writers.status_events(base, "processing", at(1)), path)
    odd = F.col("id") % 2 == 1
    writers.append_rows(writers.status_events(base.filter(odd), "failed", at(2), F.lit("Data not found")), path)
    writers.append_rows(writers.status_events(base.filter(~odd), "completed", at(2)), path)
    return writers.current_status(spark.read.schema(schemas.STATUS_EVENT).parquet(path)).select("id", "processing_status", "error")


def processed_listing(spark, folder):
    """One user's processed documents; every seventh document is theirs."""
    sub = tq.documents(spark, folder).select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("user_id"), F.timestamp_seconds("doc_id").alias("created_at"), F.lit("").alias("url"),
        F.get(tx.sentences(F.col("text")), F.lit(0)).alias("title"), tx.sentences(F.col("text")).alias("headings"),
        F.array().cast("array<string>").alias("paragraphs"), "text",
    )
    out = listing.processed_listing(docs.clean_record(sub, content="text"), 3)
    return out.select("id", "title", F.array_join("headings", "|").alias("headings"), "content_length", "headings_count", F.array_join(F.map_keys("meta"), "").alias("meta"))


def export_listing(spark, folder):
    """One user's exports, derived from the labels: toxic ones failed."""
    bad = F.col("toxic") == 1
    exports = views.table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("user_id"), F.when(F.col("quality") == 1, "csv").otherwise("json").alias("format"),
        F.when(bad, "failed").otherwise("completed").alias("status"), (F.col("doc_id") * 2).alias("record_count"),
        F.when(~bad, F.concat(F.lit("export_"), "doc_id")).alias("file_path"), F.timestamp_seconds("doc_id").alias("created_at"), F.when(bad, "disk full").alias("error"),
    )
    return listing.export_listing(exports, 2).drop("created_at")


def _task_layout(spark, folder):
    path = fresh_path(spark, "layout")
    life.write_layout(views.tasks(spark, folder).select("task_id", "user_id", "status", "created_at"), path)
    return path


def layout_scan(spark, folder):
    """Tasks stored by day and user, read back by both."""
    back = spark.read.parquet(_task_layout(spark, folder))
    return back.groupBy(F.col("day").cast("string").alias("day"), "user_id").agg(F.count("*").alias("tasks"))


def retention_applied(spark, folder):
    """Old failed tasks deleted from the stored layout."""
    path, now = _task_layout(spark, folder), mq.clock(spark, folder)
    life.expire(spark, path, life.expired_failure(now, 14))
    return spark.read.parquet(path).select("task_id", "status")


# --- streams -----------------------------------------------------------------


def arrivals(rows, runs=2, files=4, files_per_batch=2):
    """Rows that arrive in a folder in ``runs`` parts: a stream per part, over all that has arrived, of a few files per micro-batch."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "arrivals")
    for run in range(runs):
        part = rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(runs)) == run)
        part.repartition(files).write.mode("append").parquet(path)
        yield flows.read_folder(spark, path, rows.schema, files_per_batch=files_per_batch)


def stream_restart(spark, folder):
    """Three batches of documents, each handled by a new session of the flow on the same folder."""
    df, path = views.table(spark, folder, "documents").select("doc_id", "text"), fresh_path(spark, "restart")
    for batch_id in range(3):
        flows.SeenTexts(spark, "doc_id", path).update(df.filter(F.col("doc_id") % 3 == batch_id), batch_id)
    return flows.SeenTexts(spark, "doc_id", path).table().select("doc_id", "text_hash", "is_duplicate")


def stream_states_restart(spark, folder):
    """Task states over four runs of a stream, each by a new session of the flow on the same checkpoint."""
    events, path = views.task_events(spark, folder), fresh_path(spark, "states-restart")
    for stream in arrivals(events, runs=4, files=2, files_per_batch=2):
        flows.TaskStates(spark, path).run(stream)
    return micros(flows.TaskStates(spark, path).table(), "updated_at", "completed_at")


def table_stream(spark, folder, name, schema):
    """A table as a stream, whether it is one file or a folder of files (hence the glob)."""
    return flows.read_folder(spark, f"{folder}/{name}.parque[t]", schema)


def event_stream(spark, folder):
    stream = table_stream(spark, folder, "events", schemas.EVENTS)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def event_rows(spark, folder):
    return views.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def sample_rows(events):
    return events.select(
        F.col("event_id").alias("sample_id"), (F.col("user_id") % 8).alias("host"), F.col("ts").alias("timestamp"),
        F.least("value", F.lit(100.0)).alias("cpu_percent"), (F.col("event_id") % 100).cast("double").alias("memory_percent"),
        (F.col("user_id") % 100).cast("double").alias("disk_percent"),
    )


def stream_rollup(spark, folder):
    """Hourly load per host; windows the watermark has closed."""
    rolled = flows.metric_rollup(sample_rows(event_stream(spark, folder)), "1 hour", "1 hour")
    out = flows.run_available(rolled, fresh_path(spark, "rollup"))
    return rounded(micros(out, "window_start"), "cpu_avg", "memory_avg", "disk_avg")


def stream_alerts(spark, folder):
    judged = flows.alerts(sample_rows(event_stream(spark, folder))).select("sample_id", "status", F.array_join("issues", "; ").alias("issues"))
    return flows.run_available(judged, fresh_path(spark, "alerts"))


def stream_recent(spark, folder):
    """The last 60 samples of every host, over several micro-batches and a restart."""
    samples, path = sample_rows(event_rows(spark, folder)), fresh_path(spark, "recent")
    for stream in arrivals(samples):
        flows.RecentRows(spark, ["host"], ["timestamp", "sample_id"], 60, samples.schema, checkpoint=path).run(stream)
    recent = flows.RecentRows(spark, ["host"], ["timestamp", "sample_id"], 60, samples.schema, checkpoint=path)
    return recent.table().select("host", "sample_id", "cpu_percent")


def stream_task_states(spark, folder):
    """The state of every task, over several micro-batches and a restart."""
    changes = event_rows(spark, folder).select(
        F.col("user_id").alias("task_id"), views._status(F.col("event_type")).alias("status"), F.col("ts").alias("updated_at"),
        F.col("event_id").alias("sequence"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "HTTP 500").alias("error"),
    )
    path = fresh_path(spark, "states")
    for stream in arrivals(changes):
        flows.TaskStates(spark, path).run(stream)
    return micros(flows.TaskStates(spark, path).table(), "updated_at", "completed_at")


def stream_batches(spark, folder):
    items = event_stream(spark, folder).select(
        F.col("event_id").alias("item_id"), F.col("event_type").alias("batch_type"), F.col("ts").alias("created_at"),
        (F.col("value") / 1000).alias("seconds"),
    )
    log, out = fresh_path(spark, "batch-log"), fresh_path(spark, "batches")
    flows.micro_batches(items, lambda cut, trigger: cut.write.mode("overwrite").parquet(f"{out}/trigger={trigger}"), log)
    return rounded(spark.read.parquet(log).select("batch_type", "batch_id", "items", "seconds"), "seconds")


def stream_duplicates(spark, folder):
    stream = table_stream(spark, folder, "documents", "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = flows.SeenTexts(spark, "doc_id")
    flows.run_batches(stream.select("doc_id", "text"), seen.update)
    return seen.table()


def stream_ingest(spark, folder):
    """Submissions as a stream of JSON lines: cleaned or rejected."""
    source, clean, rejected = (fresh_path(spark, n) for n in ("lines", "clean", "rejected"))
    submission_lines(spark, folder).write.parquet(source)
    flows.ingest(flows.read_folder(spark, source, "id bigint, value string", files_per_batch=4), clean, rejected)
    good = spark.read.parquet(clean).select("id", "status", F.lit("").alias("problem"), "headings_count")
    bad = spark.read.parquet(rejected).select("id", "status", "problem", F.lit(None).cast("long").alias("headings_count"))
    return good.unionByName(bad)


QUERIES = {
    "page_scan": page_scan, "html_file_scan": html_file_scan, "crawl_json_scan": crawl_json_scan, "crawl_json_multiline": crawl_json_multiline,
    "processed_listing": processed_listing, "export_listing": export_listing, "layout_scan": layout_scan, "retention_applied": retention_applied,
    "stream_restart": stream_restart, "stream_states_restart": stream_states_restart, "export_rows": export_rows, "csv_export": csv_export,
    "json_export": json_export, "export_manifest": export_manifest, "metric_append": metric_append, "log_scan": log_scan,
    "compressed_output": compressed_output, "submissions": submissions, "status_writeback": status_writeback,
    "stream_rollup": stream_rollup, "stream_alerts": stream_alerts, "stream_recent": stream_recent,
    "stream_task_states": stream_task_states, "stream_batches": stream_batches, "stream_duplicates": stream_duplicates,
    "stream_ingest": stream_ingest,
}

SQL_CLEANED = f"""
    x AS (SELECT doc_id, text, {SQL_SENTENCES} AS sents FROM documents),
    y AS (SELECT doc_id, text, coalesce({sql_clean('sents[1]')}, '') AS title,
            list_filter(list_transform(sents, lambda v: {sql_clean('v')}), lambda v: length(v) > 3) AS heads FROM x),
    ex AS (SELECT -l.doc_id AS position, 'https://docs.example/' || y.doc_id AS url, title, heads, text
           FROM labels l JOIN y ON y.doc_id = l.doc_id * 2)"""
PROBLEMS = ["''", "'malformed JSON'", "'missing title'", "'missing headings'", "'invalid URL'", "'malformed JSON'"]
SQL_PROBLEM = f"[{', '.join(PROBLEMS)}][doc_id % {KINDS} + 1]"
# A document without any sentence has no title.
SQL_SUBMITTED = f"""
    sb AS (SELECT doc_id AS id, {SQL_SENTENCES} AS sents, doc_id FROM documents),
    pr AS (SELECT id, sents, CASE WHEN doc_id % {KINDS} IN (0, 3, 4) AND len(sents) = 0 THEN 'missing title' ELSE {SQL_PROBLEM} END AS problem FROM sb)"""

ORACLES = {
    "page_scan": "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars FROM pages",
    "html_file_scan": "SELECT page_id, md5(rtrim(html, chr(10))) AS html_md5 FROM pages",
    "crawl_json_multiline": f"WITH {SQL_PAGES} SELECT url AS base_url, {tq.sql_strip('title')} AS title, CAST(length(html) AS BIGINT) AS content_length FROM pg",
    "processed_listing": f"""WITH {SQL_CLEANED} SELECT doc_id AS id, title, array_to_string(heads, '|') AS headings, CAST(length(text) AS BIGINT) AS content_length,
        CAST(len(heads) AS BIGINT) AS headings_count, '' AS meta FROM y WHERE doc_id % 7 = 3""",
    "export_listing": """SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'csv' ELSE 'json' END AS format, CASE WHEN toxic = 1 THEN 'failed' ELSE 'completed' END AS status,
        doc_id * 2 AS record_count, CASE WHEN toxic = 0 THEN 'export_' || doc_id END AS file_path, CASE WHEN toxic = 1 THEN 'disk full' END AS error FROM labels WHERE doc_id % 5 = 2""",
    "layout_scan": f"WITH {mq.SQL_TASKS} SELECT CAST(created_at::DATE AS VARCHAR) AS day, user_id, count(*) AS tasks FROM tasks GROUP BY 1, 2",
    "retention_applied": mq.ORACLES["retained_tasks"],
    "stream_restart": """WITH d AS (SELECT doc_id, md5(text) AS text_hash, doc_id % 3 AS part FROM documents),
        f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_hash ORDER BY part, doc_id) AS first FROM d)
        SELECT doc_id, text_hash, doc_id <> first AS is_duplicate FROM f""",
    "stream_states_restart": mq.ORACLES["latest_state"],
    "crawl_json_scan": f"""WITH {SQL_PAGES}, {SQL_PARAS}, np AS (SELECT page_id, count(*) AS n FROM basic GROUP BY page_id)
        SELECT {tq.sql_strip('title')} AS title, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS content_length,
          CAST(sum(coalesce(n, 0)) AS BIGINT) AS paragraphs FROM pg LEFT JOIN np USING (page_id) GROUP BY 1""",
    "export_rows": f"WITH {SQL_CLEANED} SELECT position, url, title, array_to_string(heads, '|') AS headings, CAST(length(text) AS BIGINT) AS content_length FROM ex",
    "csv_export": f"WITH {SQL_CLEANED} SELECT position, url, title, CAST(to_json(heads) AS VARCHAR) AS headings FROM ex",
    "json_export": f"WITH {SQL_CLEANED} SELECT position, url, title, CAST(to_json(heads) AS VARCHAR) AS headings FROM ex",
    "export_manifest": f"""WITH {SQL_CLEANED} SELECT '7' AS user_id, f AS format, CASE WHEN f = 'yaml' THEN 0 ELSE (SELECT count(*) FROM ex) END AS record_count,
        CASE WHEN f = 'yaml' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN f = 'yaml' THEN 'Unsupported format: yaml' END AS error
        FROM (SELECT unnest(['csv', 'json', 'yaml']) AS f)""",
    "metric_append": "SELECT CAST(event_id AS VARCHAR) AS task_id, event_type AS status, value AS duration, CAST(user_id AS VARCHAR) AS user, 2::BIGINT AS extras FROM events",
    "log_scan": mq.ORACLES["request_durations"],
    "compressed_output": f"WITH {mq.SQL_TASKS} SELECT status, true AS gzipped, count(*) AS rows FROM tasks GROUP BY status",
    "submissions": f"WITH {SQL_SUBMITTED} SELECT id, problem FROM pr",
    "status_writeback": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 1 THEN 'failed' ELSE 'completed' END AS processing_status,
        CASE WHEN doc_id % 2 = 1 THEN 'Data not found' END AS error FROM documents""",
    "stream_rollup": f"""WITH {mq.SQL_SYSTEM} SELECT host, epoch_us(date_trunc('hour', ts)) AS window_start, {r('avg(cpu)')} AS cpu_avg, {r('avg(mem)')} AS memory_avg,
        {r('avg(disk)')} AS disk_avg, max(cpu) AS cpu_peak, max(mem) AS memory_peak, max(disk) AS disk_peak, count(*) AS samples
        FROM sys, clock WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= as_of - INTERVAL 1 HOUR GROUP BY 1, 2""",
    "stream_alerts": f"""WITH {mq.SQL_SYSTEM} SELECT sample_id, CASE WHEN disk > 90 THEN 'critical' ELSE 'warning' END AS status,
        {mq.sql_issues("CASE WHEN cpu > 80 THEN 'High CPU usage' END", "CASE WHEN mem > 85 THEN 'High memory usage' END", "CASE WHEN disk > 90 THEN 'High disk usage' END")} AS issues
        FROM sys WHERE cpu > 80 OR mem > 85 OR disk > 90""",
    "stream_recent": f"""WITH {mq.SQL_SYSTEM} SELECT host, sample_id, cpu AS cpu_percent FROM sys
        QUALIFY row_number() OVER (PARTITION BY host ORDER BY ts DESC, sample_id DESC) <= 60""",
    "stream_task_states": mq.ORACLES["latest_state"],
    "stream_batches": f"WITH {mq.SQL_BATCHED} SELECT batch_type, batch_id, items, {r('seconds')} AS seconds FROM log",
    "stream_duplicates": tq.ORACLES["dup_exact"],
    "stream_ingest": f"""WITH {SQL_SUBMITTED} SELECT id, CASE WHEN problem = '' THEN 'completed' ELSE 'failed' END AS status, problem,
        CASE WHEN problem = '' THEN CAST(len(list_filter(list_transform(sents, lambda v: {sql_clean('v')}), lambda v: length(v) > 3)) AS BIGINT) END AS headings_count FROM pr""",
}
