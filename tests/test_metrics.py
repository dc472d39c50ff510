from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pagemill.operators import lifecycle as life, listing, metrics as mx

NOW = datetime(2024, 3, 10, 12, tzinfo=timezone.utc)
TASK = "task_id long, status string, user_id long, created_at timestamp, completed_at timestamp, duration double, response_time double, timestamp timestamp"


def task(i, status="completed", back=0, took=None, duration=None, response=None):
    at = NOW - timedelta(seconds=back)
    return (i, status, 1, at, at + timedelta(seconds=took) if took is not None else None, duration, response, at)


@pytest.fixture
def tasks(spark):
    return lambda *rows: spark.createDataFrame(list(rows), TASK)


def test_empty_tables_give_zeros(tasks):
    none = tasks().filter("false")
    assert mx.task_statistics(none).first()[:] == (0, 0.0, 0.0)
    assert mx.response_times(none).first()[:] == (0.0, 0.0, 0.0)
    assert mx.outcome_rates(none).first()[:] == (0.0, 0.0)
    assert mx.task_analytics(none, NOW).first()[:] == (0, 0.0, 0.0)
    assert mx.performance_summary(none).first()[:4] == (0, 0.0, 0.0, 0.0)


def test_nulls_count_as_no_success(tasks):
    row = mx.task_statistics(tasks(task(1), task(2, None), task(3, "failed", duration=4.0), task(4, duration=2.0))).first()
    assert row[:] == (4, 50.0, 3.0)


def test_window_cutoff_is_inclusive(tasks):
    day = 86_400
    df = tasks(task(1, back=7 * day, took=10), task(2, back=7 * day + 1, took=99), task(3, "failed", took=20), task(4, "pending"))
    assert mx.task_analytics(df, NOW, 7).first()[:] == (3, 33.33, 15.0)
    negative = tasks(task(1, took=-5))
    assert mx.task_analytics(negative, NOW, 7).first().avg_duration == 0.0


def test_percentiles_interpolate(tasks):
    df = tasks(*[task(i, response=float(i)) for i in range(1, 6)], task(9, response=None))
    assert mx.response_times(df).first()[:] == (3.0, 3.0, pytest.approx(4.8))


def test_summary_skips_zero_durations(tasks):
    df = tasks(task(1, duration=0.0), task(2, "failed", duration=4.0), task(3, duration=None), task(4, "pending", 999, duration=50.0))
    row = mx.performance_summary(df, limit=3).first()
    assert row.average_duration == 4.0 and row.total_tasks == 3 and row.failed_tasks == 1
    assert row.error_rate == pytest.approx(100 / 3)


SAMPLE = "sample_id long, host long, timestamp timestamp, cpu_percent double, memory_percent double, disk_percent double"


def samples(spark, values, host=1):
    return spark.createDataFrame([(i, host, NOW + timedelta(seconds=i), float(v), 1.0, 1.0) for i, v in enumerate(values)], SAMPLE)


@pytest.mark.parametrize(
    "values,label",
    [([5], "stable"), ([0, 0.11], "increasing"), ([0, 0.09], "stable"), ([1, 0.5], "decreasing"), ([3, 3, 3], "stable")],
)
def test_trend(spark, values, label):
    assert mx.trend(samples(spark, values), ["host"], "sample_id").first().trend == label


def test_rolling_buffer(spark):
    out = mx.rolling_load(samples(spark, range(130)), ["host"], "sample_id", segment_rows=64)
    got = {r.sample_id: (r.cpu_rolling, r.samples) for r in out.collect()}
    assert got[0] == (0.0, 1) and got[59] == (29.5, 60) and got[129] == (99.5, 60)


def test_health_rules(spark):
    rows = [(80.0, 85.0, 90.0, 10.0), (81.0, 1.0, 1.0, 0.0), (1.0, 1.0, 91.0, 0.0), (1.0, 1.0, 91.0, 11.0)]
    df = spark.createDataFrame(rows, "cpu_percent double, memory_percent double, disk_percent double, error_rate double")
    got = [(r.status, r.issues, r.max_severity) for r in mx.health(df).collect()]
    assert got == [
        ("healthy", [], "healthy"), ("warning", ["High CPU usage"], "warning"), ("critical", ["High disk usage"], "critical"),
        ("warning", ["High disk usage", "High error rate"], "critical"),
    ]


def test_cache_rules(spark):
    df = spark.createDataFrame([(70.0, 100_000_000), (69.996, 100_000_001), (75.0, 1)], "hit_rate double, used_memory long")
    got = [(r.status, r.issues, r.log_level) for r in mx.cache_health(df).collect()]
    assert got[0] == ("healthy", [], "WARNING") and got[2][0] == "healthy"
    assert got[1] == ("warning", ["Low cache hit rate: 70.00%", "High memory usage: 100.00MB"], "WARNING")
    assert mx.hit_rate(spark.createDataFrame([("other",)], "outcome string")).first().hit_rate == 0.0


def test_histogram_heatmap_and_series(spark):
    df = spark.createDataFrame([("a", "p", -1.0), ("a", "q", 0.0), ("b", "p", 5.0), ("b", "p", 10.0)], "x string, y string, v double")
    assert {r.bin: r.rows for r in mx.histogram(df, "v", 0.0, 10.0, 2).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert sorted(mx.heatmap(df, "x", "y", "v", ["p", "q"]).collect()) == [("a", -1.0, 0.0), ("b", 7.5, 0.0)]
    series = spark.createDataFrame([("2024-01-01T00:00:09", 4), ("2024-01-01T00:00:01", 2)], "t string, v int")
    assert [r.value for r in mx.time_series(series, "t", "v").collect()] == [2.0, 4.0]
    assert [r.value for r in mx.time_series(series, "t", "v", "1 minute").collect()] == [3.0]


def test_batches(spark):
    items = spark.range(250).select(
        F.col("id").alias("item_id"), F.lit("a").alias("batch_type"), F.lit(NOW).alias("created_at"), F.lit(0.5).alias("seconds"))
    log = mx.batch_log(mx.assign_batches(items, 100))
    assert sorted((r.batch_id, r["items"], r.seconds) for r in log.collect()) == [(0, 100, 50.0), (1, 100, 50.0), (2, 50, 25.0)]
    assert mx.batch_statistics(log).first()[:] == (3, 250, pytest.approx(125 / 3))
    running = {r.batch_id: r.average_batch_time for r in mx.running_batch_time(log).collect()}
    assert running == {0: 50.0, 1: 50.0, 2: pytest.approx(125 / 3)}


def test_paging(tasks):
    df = tasks(*[task(i, back=100 - i) for i in range(30)])
    ids = lambda d: [r.task_id for r in d.collect()]
    assert ids(listing.page_of_tasks(df, 1, 1, 10)) == list(range(29, 19, -1))
    assert ids(listing.page_of_tasks(df, 1, 4, 10)) == []
    last = listing.page_of_tasks(df, 1, 1, 10).collect()[-1]
    after = (last.created_at.replace(tzinfo=timezone.utc), last.task_id)
    assert ids(listing.page_of_tasks(df, 1, 1, 10, after=after)) == ids(listing.page_of_tasks(df, 1, 2, 10))
    assert ids(listing.page_of_tasks(df, 1, 1, 10, status="failed")) == []
    for bad in [(0, 10), (1, 0), (1, 101)]:
        with pytest.raises(ValueError):
            listing.page_of_tasks(df, 1, *bad)


def test_listing_pushes_filters_and_takes_the_top(spark, tiny):
    from checks import views

    df = views.table(spark, tiny, "orders").filter(F.col("o_custkey") == 5).orderBy(F.desc("o_orderdate")).limit(3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(o_custkey,5)" in plan


def test_listings(spark):
    done = spark.createDataFrame([("a", 1, NOW, None), ("b", 1, NOW + timedelta(1), "t"), ("c", 2, NOW, "x")], "id string, user_id long, created_at timestamp, title string")
    rows = listing.processed_listing(done, 1).collect()
    assert [(r.id, r.title, r.headings, r.headings_count, r.processed_at) for r in rows] == [("b", "t", [], 0, ""), ("a", "", [], 0, "")]
    exports = spark.createDataFrame([("e", 1, "csv", "completed", 3, NOW)], "id string, user_id long, format string, status string, record_count long, created_at timestamp")
    assert listing.export_listing(exports, 1).first().asDict()["file_path"] is None
    assert listing.export_listing(exports, 2).count() == 0


def test_result_lookup(spark, tasks):
    known = tasks(task(1), task(2, "failed")).withColumn("result", F.lit("r"))
    wanted = spark.createDataFrame([(1,), (2,), (3,)], "task_id long")
    got = {r.task_id: (r.outcome, r.result) for r in listing.result_lookup(wanted, known).collect()}
    assert got == {1: ("ok", "r"), 2: ("Task not completed yet", None), 3: ("Task not found", None)}


def test_retention_is_strict_and_spares_other_states(tasks):
    day = 86_400
    df = tasks(task(1, "failed", 30 * day), task(2, "failed", 30 * day + 1), task(3, "completed", 90 * day), task(4, None, 90 * day))
    kept = life.retain(df, life.expired_failure(NOW, 30))
    assert sorted(r.task_id for r in kept.collect()) == [1, 3, 4]
    counts = life.retention_counts({"tasks": (df, life.expired_failure(NOW, 30))}).first()
    assert (counts.deleted, counts.kept) == (1, 3)


def test_layout_round_trip_and_expiry(spark, tasks, tmp_path):
    day = 86_400
    df = tasks(task(1), task(2, back=day), task(3, back=2 * day), task(4, back=2 * day - 60))
    path = str(tmp_path / "layout")
    life.write_layout(df, path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and len({str(r.day) for r in back.select("day").collect()}) == 3
    life.expire(spark, path, life.expired_before("created_at", NOW, 2))
    assert sorted(r.task_id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]  # the cutoff itself stays
    life.expire(spark, path, life.expired_before("created_at", NOW - timedelta(seconds=30), 2))
    assert sorted(r.task_id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]
    life.expire(spark, path, life.expired_before("created_at", NOW + timedelta(seconds=30), 2))
    assert sorted(r.task_id for r in spark.read.parquet(path).collect()) == [1, 2, 4]  # its day is split
    life.expire(spark, path, life.expired_before("created_at", NOW, 0.5))
    assert sorted(r.task_id for r in spark.read.parquet(path).collect()) == [1]
    assert len([d for d in (tmp_path / "layout").iterdir() if d.name.startswith("day=")]) == 1


def test_unique_keys_and_statistics(spark):
    users = spark.createDataFrame([("a", "x@y"), ("b", "x@y"), (None, None), (None, None)], "username string, email string")
    assert life.unique_violations(users, "username").count() == 0
    assert life.unique_violations(users, "email").first().asDict() == {"key_value": "x@y", "rows": 2, "key_name": "email"}
    stats = life.table_statistics({"users": users, "none": users.filter("false")})
    rows = {r.table_name: (r.rows, r.bytes, r.mean_row_bytes) for r in stats.collect()}
    assert rows["none"] == (0, 0, 0.0)
    assert rows["users"][1] == 2 * len('{"username":"a","email":"x@y"}') + 2 * len('{"username":null,"email":null}')
    assert life.store_totals(stats).first().collections == 2


def test_advice(spark):
    df = spark.createDataFrame([(1_000_000_000, 5, 50, 100), (1_000_000_001, 6, 51, 100)], "total_size_bytes long, slow_queries long, index_size long, database_size long")
    assert [len(r.recommendations) for r in life.advice(df).collect()] == [0, 3]


def test_latest_state(spark):
    rows = [(1, "pending", NOW, 0, None), (1, "failed", NOW + timedelta(1), 1, "boom"), (1, "processing", NOW + timedelta(2), 2, None), (2, "failed", NOW, 3, None), (3, "completed", NOW, 4, None)]
    df = spark.createDataFrame(rows, "task_id long, status string, updated_at timestamp, sequence long, error string")
    got = {r.task_id: r for r in life.latest_state(df).collect()}
    assert (got[1].status, got[1].error, got[1].progress, got[1].completed_at is not None) == ("processing", "boom", 10, True)
    assert (got[2].status, got[2].completed_at, got[2].progress) == ("failed", None, 0)
    assert (got[3].progress, got[3].completed_at is not None) == (100, True)
