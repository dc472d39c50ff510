"""Task, system, cache, batch and log statistics; listings and table upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed_values as fixed
from pagemill.functions.common import round_to
from pagemill.operators import lifecycle as life, listing, metrics as mx
from checks import views

# A user id that exists at every scale.
USER = 7

SQL_TASKS = """
    tasks AS (
      SELECT event_id AS task_id, 'https://site' || (user_id % 50) || '.example/' || event_type AS url,
        CASE WHEN event_type IN ('purchase', 'click') THEN 'completed' WHEN event_type = 'error' THEN 'failed'
             WHEN event_type = 'view' THEN 'processing' ELSE 'pending' END AS status,
        user_id, ts AS created_at, epoch_us(ts) AS created_us, value AS duration,
        CASE WHEN event_type IN ('purchase', 'click', 'error')
             THEN epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) END AS completed_us,
        CASE WHEN event_type IN ('purchase', 'click') THEN props END AS result,
        CASE WHEN event_type = 'error' THEN 'HTTP 500' END AS error,
        CASE WHEN event_type = 'view' THEN 'processing' ELSE 'scraping' END AS type
      FROM events
    ),
    clock AS (SELECT max(ts) AS as_of FROM events)"""
SQL_SYSTEM = """
    sys AS (
      SELECT event_id AS sample_id, user_id % 8 AS host, ts, least(value, 100.0::DOUBLE) AS cpu,
        (event_id % 100)::DOUBLE AS mem, (user_id % 100)::DOUBLE AS disk
      FROM events
    ),
    clock AS (SELECT max(ts) AS as_of FROM events)"""


def r(expr: str, digits: int = 6) -> str:
    return f"(CAST(printf('%.{digits}f', {expr}) AS DOUBLE) + 0.0::DOUBLE)"


def rounded(df, *names, digits=6):
    return df.withColumns({n: round_to(F.col(n), digits) for n in names})


def micros(df, *names):
    return df.withColumns({n: F.unix_micros(F.col(n)) for n in names})


def clock(spark, folder):
    return mx.latest_time(views.events(spark, folder), "ts")


def task_stats(spark, folder):
    return rounded(mx.task_statistics(views.tasks(spark, folder)), "success_rate", "average_duration")


def status_breakdown(spark, folder):
    return mx.status_breakdown(views.tasks(spark, folder))


def hourly(spark, folder):
    return mx.hourly_distribution(views.tasks(spark, folder)).withColumn("hour", F.col("hour").cast("long"))


def daily(spark, folder):
    return mx.daily_distribution(views.tasks(spark, folder)).withColumn("day", F.col("day").cast("string"))


def response_pct(spark, folder):
    return rounded(mx.response_times(views.tasks(spark, folder)), "mean", "median", "p95")


def response_pct_by_status(spark, folder):
    return rounded(mx.response_times(views.tasks(spark, folder), ["status"]), "mean", "median", "p95")


def rates(spark, folder):
    return rounded(mx.outcome_rates(views.task_outcomes(spark, folder)), "error_rates", "success_rates")


def task_window(spark, folder):
    return mx.task_analytics(views.tasks(spark, folder), clock(spark, folder), days=7)


def task_window_daily(spark, folder):
    recent = mx.since(views.tasks(spark, folder), "created_at", clock(spark, folder), days=7)
    return mx.daily_distribution(recent).withColumn("day", F.col("day").cast("string"))


def system_stats(spark, folder):
    return mx.system_analytics(views.system_metrics(spark, folder), clock(spark, folder), hours=24)


def trend(spark, folder):
    return rounded(mx.trend(views.system_metrics(spark, folder), ["host"], "sample_id"), "slope", digits=9)


def time_series(spark, folder):
    out = mx.time_series(views.system_metrics(spark, folder), "timestamp", "cpu_percent", "1 hour")
    return micros(rounded(out, "value"), "timestamp")


def histogram(spark, folder):
    return mx.histogram(views.tasks(spark, folder), "duration", 0.0, 100.0, 20)


def time_series_raw(spark, folder):
    return micros(mx.time_series(views.events(spark, folder), "ts", "value"), "timestamp")


def heatmap_other(spark, folder):
    """Values of y that are not listed go to a column of their own."""
    df = views.events(spark, folder).withColumn("shard", F.col("user_id") % 4)
    out = mx.heatmap(df, "event_type", "shard", "value", [0, 1], other="rest").toDF("event_type", "y0", "y1", "rest")
    return rounded(out, "y0", "y1", "rest")


def heatmap(spark, folder):
    df = views.events(spark, folder).withColumn("shard", F.col("user_id") % 4)
    out = mx.heatmap(df, "event_type", "shard", "value", [0, 1, 2, 3])
    out = out.toDF("event_type", "y0", "y1", "y2", "y3")
    return rounded(out, "y0", "y1", "y2", "y3")


def perf_summary(spark, folder):
    return rounded(mx.performance_summary(views.tasks(spark, folder)), "success_rate", "error_rate", "average_duration")


def health(spark, folder):
    """Each sample judged with its host's error rate."""
    failed = mx.share(F.col("event_type") == "error").alias("error_rate")
    per_host = views.events(spark, folder).groupBy((F.col("user_id") % 8).alias("host")).agg(failed)
    judged = mx.health(views.system_metrics(spark, folder).join(per_host, "host"))
    return judged.select("sample_id", "status", "max_severity", F.array_join("issues", "; ").alias("issues"))


def active(spark, folder):
    return mx.active_tasks(views.tasks(spark, folder))


def hit_rate(spark, folder):
    return rounded(mx.hit_rate(views.cache_reads(spark, folder), ["hour"]), "hit_rate").withColumn(
        "hour", F.col("hour").cast("long")
    )


def cache_health(spark, folder):
    reads = views.cache_reads(spark, folder)
    memory = reads.groupBy("hour").agg(F.sum("bytes").alias("used_memory"))
    out = mx.cache_health(mx.hit_rate(reads, ["hour"]).join(memory, "hour"))
    return out.select(
        F.col("hour").cast("long").alias("hour"), "status", F.array_join("issues", "; ").alias("issues"), "log_level"
    )


def batch_assign(spark, folder):
    return mx.assign_batches(views.batch_items(spark, folder)).select("item_id", "batch_type", "batch_id")


def batch_stats(spark, folder):
    log = mx.batch_log(mx.assign_batches(views.batch_items(spark, folder)))
    return rounded(mx.batch_statistics(log), "average_batch_time")


def batch_running(spark, folder):
    log = mx.batch_log(mx.assign_batches(views.batch_items(spark, folder)))
    out = mx.running_batch_time(log).select("batch_type", "batch_id", "items", "seconds", "average_batch_time")
    return rounded(out, "seconds", "average_batch_time")


def request_durations(spark, folder):
    return rounded(mx.request_durations(views.request_log(spark, folder)), "avg_duration", "p95_duration")


def function_durations(spark, folder):
    return rounded(mx.function_durations(views.request_log(spark, folder)), "avg_duration", "p95_duration")


def rolling_60(spark, folder):
    out = mx.rolling_load(views.system_metrics(spark, folder), ["host"], "sample_id")
    out = rounded(out, "cpu_rolling", "memory_rolling", "disk_rolling", digits=9)
    return out.select("sample_id", "host", "cpu_rolling", "memory_rolling", "disk_rolling", "samples")


def scan(spark, folder):
    tasks = views.tasks(spark, folder)
    out = listing.collection_scan(tasks, (F.col("user_id") == USER) & (F.col("duration") > 5), [F.col("created_at")])
    return micros(out.select("task_id", "status", "created_at", "duration"), "created_at")


def point_lookup(spark, folder):
    out = listing.point_lookup(views.tasks(spark, folder), "task_id", 2, "user_id", USER)
    return micros(out.select("task_id", "url", "status", "created_at"), "created_at")


def bulk_lookup(spark, folder):
    wanted = views.table(spark, folder, "labels").select(F.col("doc_id").alias("task_id"))
    return listing.bulk_lookup(views.tasks(spark, folder), wanted, "task_id").select("task_id", "status", "url")


def page_of_tasks(spark, folder):
    out = listing.page_of_tasks(views.tasks(spark, folder), USER, page=2, page_size=20)
    return micros(out.select("task_id", "status", "created_at"), "created_at")


def page_after(spark, folder):
    """The page after the user's 20th newest completed task, found by keyset instead of offset."""
    tasks = views.tasks(spark, folder)
    first = listing.page_of_tasks(tasks, USER, 1, 20, "completed").select("created_at", "task_id")
    last = first.orderBy("created_at", "task_id").first()
    out = listing.page_of_tasks(tasks, USER, 1, 20, "completed", (last["created_at"], last["task_id"]))
    return micros(out.select("task_id", "status", "created_at"), "created_at")


def latest_k(spark, folder):
    out = mx.latest(views.tasks(spark, folder).select("task_id", "timestamp", "status", "duration"), 100)
    return micros(out, "timestamp")


def history(spark, folder):
    return micros(listing.system_history(views.system_metrics(spark, folder), clock(spark, folder), 24), "timestamp")


def processing_tasks(spark, folder):
    return micros(listing.processing_tasks(views.tasks(spark, folder), USER), "created_at")


def slow_top_k(spark, folder):
    out = listing.slow_queries(views.query_log(spark, folder), 10)
    return micros(out, "timestamp").drop("planSummary")


def result_lookup(spark, folder):
    """Results asked for by document id; ids beyond the task table are not found."""
    wanted = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("task_id")).distinct()
    return listing.result_lookup(wanted, views.tasks(spark, folder))


def retention(spark, folder):
    now = clock(spark, folder)
    tasks, system = views.tasks(spark, folder), views.system_metrics(spark, folder)
    return life.retention_counts({
        "system_metrics": (system, life.expired_before("timestamp", now, 7)),
        "task_metrics": (tasks, life.expired_before("timestamp", now, 30)),
        "tasks": (tasks, life.expired_failure(now, 14)),
    })


def retained_tasks(spark, folder):
    tasks = views.tasks(spark, folder)
    return life.retain(tasks, life.expired_failure(clock(spark, folder), 14)).select("task_id", "status")


def unique_violations(spark, folder):
    names = life.unique_violations(views.table(spark, folder, "part"), "p_name")
    ids = life.unique_violations(views.table(spark, folder, "customer"), "c_custkey")
    return names.unionByName(ids)


STAT_TABLES = ["region", "nation", "documents", "labels", "conversations", "pages", "benchmark"]


def table_stats(spark, folder):
    out = life.table_statistics({name: views.table(spark, folder, name) for name in STAT_TABLES})
    return rounded(out, "mean_row_bytes")


def store_totals(spark, folder):
    stats = life.table_statistics({name: views.table(spark, folder, name) for name in STAT_TABLES})
    return rounded(life.store_totals(stats), "average_document_size")


#: Columns of all tables as SQL names their types; bytes are those of the values, the same in both engines.
COLUMNS = {
    "region": "r_regionkey int, r_name text", "nation": "n_nationkey int, n_name text, n_regionkey int",
    "customer": "c_custkey long, c_name text, c_nationkey int, c_acctbal long, c_mktsegment text",
    "supplier": "s_suppkey long, s_name text, s_nationkey int, s_acctbal long",
    "part": "p_partkey long, p_name text, p_brand text, p_type text, p_size int, p_retailprice long",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus text, o_totalprice long, o_orderdate long, o_orderpriority text",
    "lineitem": """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity long, l_extendedprice long, l_discount long, l_tax long,
        l_returnflag text, l_linestatus text, l_shipdate long""",
    "events": "event_id long, ts long, user_id long, event_type text, value long, props text",
    "documents": "doc_id long, text text, lang text, source text, n_chars long", "embeddings": "vec_id long, embedding floats, label int",
    "pages": "page_id long, url text, html text", "benchmark": "item_id long, text text", "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role text, text text",
}


def table_stats_all(spark, folder):
    """Rows and bytes of all tables."""
    out = life.table_statistics({name: views.table(spark, folder, name) for name in COLUMNS}, life.row_bytes)
    return rounded(out, "mean_row_bytes")


def store_totals_all(spark, folder):
    stats = life.table_statistics({name: views.table(spark, folder, name) for name in COLUMNS}, life.row_bytes)
    return rounded(life.store_totals(stats), "average_document_size")


def store_advice(spark, folder):
    """Advice per store collection: sizes from its query volume, slow queries from its log."""
    log = views.query_log(spark, folder)
    per = log.groupBy("ns").agg(
        (F.sum("millis") * 10_000).alias("total_size_bytes"),
        F.count_if(F.col("millis") > fixed.SLOW_QUERY_MILLIS).alias("slow_queries"),
        F.sum("millis").alias("database_size"),
        F.sum(F.when(F.col("op") == "view", F.col("millis")).otherwise(0)).alias("index_size"),
    )
    out = life.advice(per)
    return out.select("ns", "slow_queries", F.array_join("recommendations", "; ").alias("recommendations"))


def latest_state(spark, folder):
    return micros(life.latest_state(views.task_events(spark, folder)), "updated_at", "completed_at")


QUERIES = {
    "task_stats": task_stats, "status_breakdown": status_breakdown, "hourly": hourly, "daily": daily,
    "response_pct": response_pct, "response_pct_by_status": response_pct_by_status, "rates": rates,
    "task_window": task_window, "task_window_daily": task_window_daily, "system_stats": system_stats,
    "trend": trend, "time_series": time_series, "histogram": histogram, "heatmap": heatmap,
    "time_series_raw": time_series_raw, "heatmap_other": heatmap_other,
    "perf_summary": perf_summary, "health": health, "active_tasks": active, "hit_rate": hit_rate,
    "cache_health": cache_health, "batch_assign": batch_assign, "batch_stats": batch_stats,
    "batch_running": batch_running, "request_durations": request_durations,
    "function_durations": function_durations, "rolling_60": rolling_60, "collection_scan": scan,
    "point_lookup": point_lookup, "bulk_lookup": bulk_lookup, "page_of_tasks": page_of_tasks,
    "page_after": page_after, "latest_k": latest_k, "history": history, "processing_tasks": processing_tasks,
    "slow_top_k": slow_top_k, "result_lookup": result_lookup, "retention": retention,
    "retained_tasks": retained_tasks, "unique_violations": unique_violations, "table_stats": table_stats,
    "store_totals": store_totals, "store_advice": store_advice, "latest_state": latest_state,
    "table_stats_all": table_stats_all, "store_totals_all": store_totals_all,
}


def pct(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100"


def sql_issues(*pairs: str) -> str:
    return "concat_ws('; ', " + ", ".join(pairs) + ")"


SQL_BATCHED = """
    items AS (
      SELECT event_id AS item_id, event_type AS batch_type, ts, value / 1000 AS seconds,
        (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 100 AS batch_id
      FROM events
    ),
    log AS (SELECT batch_type, batch_id, count(*) AS items, sum(seconds) AS seconds FROM items GROUP BY ALL)"""
SQL_LOG = """
    lg AS (
      SELECT *, event_type IN ('click', 'view', 'purchase') AS request,
        ['GET', 'POST', 'PUT'][user_id % 3 + 1] AS method FROM events
    )"""
SQL_CACHE = """
    reads AS (
      SELECT hour(ts) AS hour, count(*) FILTER (WHERE event_type = 'click') AS hits,
        count(*) FILTER (WHERE event_type = 'view') AS misses, sum(CAST(floor(value * 10000) AS BIGINT)) AS mem
      FROM events GROUP BY 1
    ),
    hr AS (SELECT *, CASE WHEN hits + misses > 0 THEN hits::DOUBLE / (hits + misses) * 100 ELSE 0.0::DOUBLE END AS rate FROM reads)"""
SQL_STATS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, CAST(sum(strlen(CAST(to_json({t}) AS VARCHAR))) AS BIGINT) AS bytes FROM {t}"
    for t in STAT_TABLES
)


def _sql_bytes(columns: str) -> str:
    sizes = {"int": "4 * count({c})", "long": "8 * count({c})", "text": "coalesce(sum(strlen({c})), 0)", "floats": "coalesce(sum(4 * list_count({c})), 0)"}
    pairs = [column.split() for column in columns.split(",")]
    return " + ".join(sizes[kind].format(c=name) for name, kind in pairs)


SQL_STATS_ALL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, CAST({_sql_bytes(c)} AS BIGINT) AS bytes FROM {t}" for t, c in COLUMNS.items())

ORACLES = {
    "table_stats_all": f"WITH s AS ({SQL_STATS_ALL}) SELECT table_name, rows, bytes, {r('bytes::DOUBLE / rows')} AS mean_row_bytes FROM s",
    "store_totals_all": f"""WITH s AS ({SQL_STATS_ALL}) SELECT CAST(sum(rows) AS BIGINT) AS total_documents, CAST(sum(bytes) AS BIGINT) AS total_size_bytes,
        count(*) AS collections, {r('sum(bytes)::DOUBLE / sum(rows)')} AS average_document_size FROM s""",
    "task_stats": f"WITH {SQL_TASKS} SELECT count(*) AS total_tasks, {r(pct(chr(115) + 'tatus = ' + repr('completed')))} AS success_rate, {r('avg(duration)')} AS average_duration FROM tasks",
    "status_breakdown": f"WITH {SQL_TASKS} SELECT status, count(*) AS tasks FROM tasks GROUP BY status",
    "hourly": f"WITH {SQL_TASKS} SELECT hour(created_at) AS hour, count(*) AS tasks FROM tasks GROUP BY 1",
    "daily": f"WITH {SQL_TASKS} SELECT CAST(created_at::DATE AS VARCHAR) AS day, count(*) AS tasks FROM tasks GROUP BY 1",
    "response_pct": f"SELECT {r('avg(value)')} AS mean, {r('median(value)')} AS median, {r('quantile_cont(value, 0.95)')} AS p95 FROM events",
    "response_pct_by_status": f"WITH {SQL_TASKS} SELECT status, {r('avg(duration)')} AS mean, {r('median(duration)')} AS median, {r('quantile_cont(duration, 0.95)')} AS p95 FROM tasks GROUP BY status",
    "rates": f"SELECT {r(pct(chr(101) + 'vent_type = ' + repr('error')))} AS error_rates, {r(pct('event_type IN (' + repr('purchase') + ', ' + repr('click') + ')'))} AS success_rates FROM events",
    "task_window": f"""WITH {SQL_TASKS}, w AS (SELECT tasks.* FROM tasks, clock WHERE created_at >= as_of - INTERVAL 7 DAY)
        SELECT count(*) AS total_tasks, {r("avg(CASE WHEN status = 'completed' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100", 2)} AS success_rate,
          CASE WHEN avg((completed_us - created_us)::DOUBLE / 1000000) > 0
               THEN {r('avg((completed_us - created_us)::DOUBLE / 1000000)', 2)} ELSE 0.0::DOUBLE END AS avg_duration FROM w""",
    "task_window_daily": f"""WITH {SQL_TASKS} SELECT CAST(created_at::DATE AS VARCHAR) AS day, count(*) AS tasks
        FROM tasks, clock WHERE created_at >= as_of - INTERVAL 7 DAY GROUP BY 1""",
    "system_stats": f"""WITH {SQL_SYSTEM} SELECT {r('avg(cpu)', 2)} AS cpu_avg, {r('avg(mem)', 2)} AS memory_avg, {r('avg(disk)', 2)} AS disk_avg,
          {r('max(cpu)', 2)} AS peak_cpu, {r('max(mem)', 2)} AS peak_memory, count(*) AS data_points
        FROM sys, clock WHERE ts >= as_of - INTERVAL 24 HOUR""",
    "trend": f"""WITH {SQL_SYSTEM}, ix AS (SELECT host, cpu, row_number() OVER (PARTITION BY host ORDER BY ts, sample_id) - 1 AS i FROM sys),
        f AS (SELECT host, regr_slope(cpu, i) AS slope, count(*) AS n FROM ix GROUP BY host)
        SELECT host, {r('slope', 9)} AS slope, n AS data_points, CASE WHEN n > 1 AND slope > 0.1 THEN 'increasing'
          WHEN n > 1 AND slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM f""",
    "time_series": f"WITH {SQL_SYSTEM} SELECT epoch_us(date_trunc('hour', ts)) AS timestamp, {r('avg(cpu)')} AS value, count(*) AS points FROM sys GROUP BY 1",
    "histogram": """SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE floor(value / 100 * 20) + 1 END AS BIGINT) AS bin,
        count(*) AS rows FROM events GROUP BY 1""",
    "time_series_raw": "SELECT epoch_us(ts) AS timestamp, value FROM events",
    "heatmap_other": "SELECT event_type, " + ", ".join(
        r(f"coalesce(avg(value) FILTER (WHERE {c}), 0.0)") + f" AS {n}" for n, c in (("y0", "user_id % 4 = 0"), ("y1", "user_id % 4 = 1"), ("rest", "user_id % 4 > 1"))
    ) + " FROM events GROUP BY 1",
    "heatmap": "SELECT event_type, " + ", ".join(
        r(f"coalesce(avg(value) FILTER (WHERE user_id % 4 = {y}), 0.0)") + f" AS y{y}" for y in range(4)
    ) + " FROM events GROUP BY 1",
    "perf_summary": f"""WITH {SQL_TASKS}, l AS (SELECT * FROM tasks ORDER BY created_at DESC, task_id DESC LIMIT 100)
        SELECT count(*) AS total_tasks, {r(pct("status = 'completed'"))} AS success_rate, {r(pct("status = 'failed'"))} AS error_rate,
          {r('coalesce(avg(duration) FILTER (WHERE duration <> 0), 0.0)')} AS average_duration,
          count(*) FILTER (WHERE status = 'completed') AS successful_tasks, count(*) FILTER (WHERE status = 'failed') AS failed_tasks FROM l""",
    "health": f"""WITH {SQL_SYSTEM}, e AS (SELECT user_id % 8 AS host, {pct("event_type = 'error'")} AS er FROM events GROUP BY 1)
        SELECT sample_id, CASE WHEN er > 10 THEN 'warning' WHEN disk > 90 THEN 'critical' WHEN mem > 85 OR cpu > 80 THEN 'warning' ELSE 'healthy' END AS status,
          CASE WHEN disk > 90 THEN 'critical' WHEN er > 10 OR mem > 85 OR cpu > 80 THEN 'warning' ELSE 'healthy' END AS max_severity,
          {sql_issues("CASE WHEN cpu > 80 THEN 'High CPU usage' END", "CASE WHEN mem > 85 THEN 'High memory usage' END",
                      "CASE WHEN disk > 90 THEN 'High disk usage' END", "CASE WHEN er > 10 THEN 'High error rate' END")} AS issues
        FROM sys JOIN e USING (host)""",
    "active_tasks": f"WITH {SQL_TASKS} SELECT count(*) FILTER (WHERE status = 'processing') AS active_tasks, count(*) AS total_tasks FROM tasks",
    "hit_rate": f"WITH {SQL_CACHE} SELECT hour, hits, misses, {r('rate')} AS hit_rate FROM hr",
    "cache_health": f"""WITH {SQL_CACHE} SELECT hour, CASE WHEN rate < 70 OR mem > 100000000 THEN 'warning' ELSE 'healthy' END AS status,
        {sql_issues("CASE WHEN rate < 70 THEN printf('Low cache hit rate: %.2f%%', rate) END",
                    "CASE WHEN mem > 100000000 THEN printf('High memory usage: %.2fMB', mem::DOUBLE / 1000000) END")} AS issues,
        CASE WHEN rate < 80 THEN 'WARNING' ELSE 'INFO' END AS log_level FROM hr""",
    "batch_assign": f"WITH {SQL_BATCHED} SELECT item_id, batch_type, batch_id FROM items",
    "batch_stats": f"WITH {SQL_BATCHED} SELECT count(*) AS batches_processed, CAST(sum(items) AS BIGINT) AS total_processed, {r('avg(seconds)')} AS average_batch_time FROM log",
    "batch_running": f"""WITH {SQL_BATCHED} SELECT batch_type, batch_id, items, {r('seconds')} AS seconds,
        {r('avg(seconds) OVER (PARTITION BY batch_type ORDER BY batch_id)')} AS average_batch_time FROM log""",
    "request_durations": f"""WITH {SQL_LOG} SELECT method, '/' || event_type AS path, count(*) AS calls, {r('avg(value)')} AS avg_duration,
        {r('quantile_cont(value, 0.95)')} AS p95_duration FROM lg WHERE request GROUP BY 1, 2""",
    "function_durations": f"""WITH {SQL_LOG} SELECT 'handle_' || event_type AS function, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
        count(*) AS calls, {r('avg(value)')} AS avg_duration, {r('quantile_cont(value, 0.95)')} AS p95_duration FROM lg WHERE NOT request GROUP BY 1, 2""",
    "rolling_60": f"""WITH {SQL_SYSTEM} SELECT sample_id, host, {r('avg(cpu) OVER w', 9)} AS cpu_rolling, {r('avg(mem) OVER w', 9)} AS memory_rolling,
        {r('avg(disk) OVER w', 9)} AS disk_rolling, count(*) OVER w AS samples FROM sys
        WINDOW w AS (PARTITION BY host ORDER BY ts, sample_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "collection_scan": f"WITH {SQL_TASKS} SELECT task_id, status, created_us AS created_at, duration FROM tasks WHERE user_id = {USER} AND duration > 5",
    "point_lookup": f"WITH {SQL_TASKS} SELECT task_id, url, status, created_us AS created_at FROM tasks WHERE task_id = 2 AND user_id = {USER}",
    "bulk_lookup": f"WITH {SQL_TASKS} SELECT task_id, status, url FROM tasks WHERE task_id IN (SELECT doc_id FROM labels)",
    "page_of_tasks": f"WITH {SQL_TASKS} SELECT task_id, status, created_us AS created_at FROM tasks WHERE user_id = {USER} ORDER BY created_us DESC, task_id DESC LIMIT 20 OFFSET 20",
    "page_after": f"WITH {SQL_TASKS} SELECT task_id, status, created_us AS created_at FROM tasks WHERE user_id = {USER} AND status = 'completed' ORDER BY created_us DESC, task_id DESC LIMIT 20 OFFSET 20",
    "latest_k": f"WITH {SQL_TASKS} SELECT task_id, created_us AS timestamp, status, duration FROM tasks ORDER BY created_us DESC, task_id DESC LIMIT 100",
    "history": f"WITH {SQL_SYSTEM} SELECT host, sample_id, epoch_us(ts) AS timestamp, cpu, mem AS memory, disk FROM sys, clock WHERE ts >= as_of - INTERVAL 24 HOUR",
    "processing_tasks": f"WITH {SQL_TASKS} SELECT task_id AS id, status, '' AS data_id, created_us AS created_at, result, error FROM tasks WHERE user_id = {USER} AND type = 'processing'",
    "slow_top_k": "SELECT event_type AS operation, 'store.t' || (user_id % 5) AS collection, CAST(floor(value * 10) AS BIGINT) AS duration_ms, epoch_us(ts) AS timestamp, props AS query FROM events WHERE floor(value * 10) > 100 ORDER BY floor(value * 10) DESC, event_id LIMIT 10",
    "result_lookup": f"""WITH {SQL_TASKS}, w AS (SELECT DISTINCT o_orderkey AS task_id FROM orders)
        SELECT w.task_id, CASE WHEN t.status IS NULL THEN 'Task not found' WHEN t.status <> 'completed' THEN 'Task not completed yet' ELSE 'ok' END AS outcome,
          CASE WHEN t.status = 'completed' THEN t.result END AS result FROM w LEFT JOIN tasks t USING (task_id)""",
    "retention": f"""WITH {SQL_TASKS}
        SELECT 'system_metrics' AS table_name, count(*) FILTER (WHERE created_at < as_of - INTERVAL 7 DAY) AS deleted, count(*) FILTER (WHERE NOT (created_at < as_of - INTERVAL 7 DAY)) AS kept FROM tasks, clock
        UNION ALL SELECT 'task_metrics', count(*) FILTER (WHERE created_at < as_of - INTERVAL 30 DAY), count(*) FILTER (WHERE NOT (created_at < as_of - INTERVAL 30 DAY)) FROM tasks, clock
        UNION ALL SELECT 'tasks', count(*) FILTER (WHERE status = 'failed' AND created_at < as_of - INTERVAL 14 DAY), count(*) FILTER (WHERE NOT (status = 'failed' AND created_at < as_of - INTERVAL 14 DAY)) FROM tasks, clock""",
    "retained_tasks": f"WITH {SQL_TASKS} SELECT task_id, status FROM tasks, clock WHERE NOT (status = 'failed' AND created_at < as_of - INTERVAL 14 DAY)",
    "unique_violations": """SELECT 'p_name' AS key_name, p_name AS key_value, count(*) AS rows FROM part GROUP BY p_name HAVING count(*) > 1
        UNION ALL SELECT 'c_custkey', CAST(c_custkey AS VARCHAR), count(*) FROM customer GROUP BY c_custkey HAVING count(*) > 1""",
    "table_stats": f"WITH s AS ({SQL_STATS}) SELECT table_name, rows, bytes, {r('bytes::DOUBLE / rows')} AS mean_row_bytes FROM s",
    "store_totals": f"""WITH s AS ({SQL_STATS}) SELECT CAST(sum(rows) AS BIGINT) AS total_documents, CAST(sum(bytes) AS BIGINT) AS total_size_bytes,
        count(*) AS collections, {r('sum(bytes)::DOUBLE / sum(rows)')} AS average_document_size FROM s""",
    "store_advice": f"""WITH q AS (SELECT 'store.t' || (user_id % 5) AS ns, event_type, CAST(floor(value * 10) AS BIGINT) AS ms FROM events),
        g AS (SELECT ns, sum(ms) * 10000 AS size, count(*) FILTER (WHERE ms > 100) AS slow, sum(ms) AS db,
                sum(CASE WHEN event_type = 'view' THEN ms ELSE 0 END) AS ix FROM q GROUP BY ns)
        SELECT ns, slow AS slow_queries, {sql_issues(f"CASE WHEN size > 1000000000 THEN '{fixed.ADVICE_ARCHIVE}' END",
            f"CASE WHEN slow > 5 THEN '{fixed.ADVICE_SLOW}' END", f"CASE WHEN ix > db * 0.5 THEN '{fixed.ADVICE_INDEX}' END")} AS recommendations FROM g""",
    "latest_state": """WITH e AS (SELECT user_id AS task_id, CASE WHEN event_type IN ('purchase', 'click') THEN 'completed' WHEN event_type = 'error' THEN 'failed'
             WHEN event_type = 'view' THEN 'processing' ELSE 'pending' END AS status, epoch_us(ts) AS us, event_id,
             CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'HTTP 500' END AS error FROM events),
        g AS (SELECT task_id, arg_max(status, (us, event_id)) AS status, max(us) AS updated_at,
          max(us) FILTER (WHERE status = 'completed' OR (status = 'failed' AND error IS NOT NULL)) AS completed_at,
          arg_max(error, (us, event_id)) FILTER (WHERE error IS NOT NULL) AS error, count(*) AS changes FROM e GROUP BY task_id)
        SELECT *, CAST(CASE status WHEN 'processing' THEN 10 WHEN 'completed' THEN 100 ELSE 0 END AS BIGINT) AS progress FROM g""",
}
