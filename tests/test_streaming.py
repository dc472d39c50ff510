"""Streams over several micro-batches give what the batch operators give over all rows."""

import json
import random
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from pagemill.operators import documents as docs, lifecycle, metrics as mx
from checks import views
from pagemill.streaming import flows, keyed

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def parts(spark, tmp_path):
    """Write a DataFrame as n files and read it back as a stream of one file per batch."""

    def make(df, n=4, name="in"):
        path = str(tmp_path / name)
        df.repartition(n).write.parquet(path)
        return flows.read_folder(spark, path, df.schema, files_per_batch=1)

    return make


def test_recent_rows(spark, tiny, tmp_path):
    """Several micro-batches and a restart; a hot host is cut before the shuffle."""
    samples = views.system_metrics(spark, tiny).select("host", "sample_id", "timestamp", "cpu_percent")
    make = lambda: flows.RecentRows(spark, ["host"], ["timestamp", "sample_id"], 60, samples.schema, checkpoint=str(tmp_path / "state"))
    assert make().table().collect() == []
    path, changes = str(tmp_path / "in"), str(tmp_path / "changes")
    for run in range(2):
        samples.filter(F.col("sample_id") % 2 == run).repartition(3).write.mode("append").parquet(path)
        make().run(flows.read_folder(spark, path, samples.schema, files_per_batch=2), changes)
    want = sorted(make().newest(samples).collect())
    assert sorted(make().table().collect()) == want
    written = spark.read.parquet(changes)
    assert written.agg(F.max("batch")).first()[0] >= 3
    last = written.join(written.groupBy("host").agg(F.max("batch").alias("batch")), ["host", "batch"]).select(samples.columns)
    assert sorted(last.collect()) == want


def test_newest_per_key_before_the_shuffle():
    """The reduction in front of the state equals a sort, however often it is applied and whatever it may hold."""
    draw = random.Random(2)
    rows = [(draw.choice([None, "a", "b", "c"]), draw.choice([None, *range(50)]), n) for n in range(3000)]
    table = pa.table({"k": [r[0] for r in rows], "at": [r[1] for r in rows], "n": [r[2] for r in rows]})
    want = []
    for key in (None, "a", "b", "c"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=True)
        want += mine[:7]
    for hold in (100_000, 500, 20):
        cut = lambda t: keyed.newest(t, ["k"], ["at", "n"], 7)
        got = pa.Table.from_batches(keyed.reduced(cut, hold)(iter(table.to_batches(max_chunksize=100))))
        assert sorted(map(str, (tuple(r.values()) for r in cut(got).to_pylist()))) == sorted(map(str, want))
    assert keyed.newest(table.slice(0, 0), ["k"], ["at"], 3).num_rows == 0


def test_task_states(spark, tiny, tmp_path):
    events = views.task_events(spark, tiny)
    path = str(tmp_path / "in")
    for run in range(2):
        events.filter(F.col("sequence") % 2 == run).repartition(3).write.mode("append").parquet(path)
        flows.TaskStates(spark, str(tmp_path / "state")).run(flows.read_folder(spark, path, events.schema, files_per_batch=2))
    want = lifecycle.latest_state(events)
    got = flows.TaskStates(spark, str(tmp_path / "state")).table()
    assert sorted(got.select(*want.columns).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_odd_changes(spark, tmp_path):
    """Null tasks, times, states and errors, repeated changes: as the batch operator has them."""
    draw = random.Random(4)
    rows = [
        (draw.choice([None, "a", "b", "c"]), draw.choice([None, "failed", "completed", "processing", "pending"]), draw.choice([None, *(T0 + timedelta(seconds=s) for s in range(9))]), n // 2, draw.choice([None, "x", "y"]))
        for n in range(300)
    ]
    events = spark.createDataFrame(rows, "task_id string, status string, updated_at timestamp, sequence long, error string").dropDuplicates(["sequence"])
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    states = flows.TaskStates(spark)
    states.run(flows.read_folder(spark, str(tmp_path / "in"), events.schema, files_per_batch=2))
    want = lifecycle.latest_state(events)
    assert sorted(states.table().select(*want.columns).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_timers_forget(spark, tmp_path):
    """Ended tasks and silent hosts leave the state once the watermark has passed their time; others stay."""
    rows = [[("a", "completed", 0, 0), ("b", "processing", 0, 1)], [("c", "pending", 500, 2)], [("c", "pending", 501, 3)], [("c", "pending", 502, 4)]]
    tasks, hosts = str(tmp_path / "tasks"), str(tmp_path / "hosts")
    schema = "task_id string, status string, updated_at timestamp, sequence long, error string"
    for batch in rows:
        df = spark.createDataFrame([(t, s, T0 + timedelta(seconds=at), n, None) for t, s, at, n in batch], schema)
        df.coalesce(1).write.mode("append").parquet(tasks)
        stream = flows.read_folder(spark, tasks, df.schema)
        flows.TaskStates(spark, str(tmp_path / "s1"), forget_after="60 seconds", late="1 second").run(stream)
        kept = df.schema.fields[:1] + df.schema.fields[2:4]
        recent = flows.RecentRows(spark, ["task_id"], ["updated_at"], 3, T.StructType(kept), checkpoint=hosts, forget_after="60 seconds", late="1 second")
        recent.run(stream)
    assert sorted(r.task_id for r in flows.TaskStates(spark, str(tmp_path / "s1")).table().collect()) == ["b", "c"]
    assert sorted((r.task_id, r.sequence) for r in recent.table().collect()) == [("c", 2), ("c", 3), ("c", 4)]


def test_seen_texts(spark, parts):
    rows = [(i, f"text {i % 5}") for i in range(40)]
    stream = parts(spark.createDataFrame(rows, "id long, text string"))
    seen = flows.SeenTexts(spark, "id")
    flows.run_batches(stream, seen.update)
    marks = seen.table().collect()
    assert len(marks) == 40 and sum(not r.is_duplicate for r in marks) == 5
    first = {r.text_hash: r.id for r in marks if not r.is_duplicate}
    assert all(r.first_seen == first[r.text_hash] for r in marks if r.is_duplicate)


def test_restarts(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(60)], "id long, text string")
    path = str(tmp_path / "seen")
    for batch in [*range(10), 9]:  # the last one is handled again
        flows.SeenTexts(spark, "id", path).update(rows.filter(F.floor(F.col("id") / 6) == batch), batch)
    marks = flows.SeenTexts(spark, "id", path).table().collect()
    assert len(marks) == 60 and sorted(r.id for r in marks if not r.is_duplicate) == list(range(7))
    assert len(list((tmp_path / "seen" / "filter").glob("batch=*"))) == 2


def test_new_texts_read_no_stored_hash(spark, tmp_path):
    """The filter stands before the hashes: new texts are ruled out by it, an old one opens its bucket alone."""
    make = lambda ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, text string")
    seen = flows.SeenTexts(spark, "id", str(tmp_path / "seen"))
    seen.update(make(range(2000)), 0)
    hashed = lambda ids: docs.hashed_texts(make(ids), "id")
    assert seen._known(hashed(range(10_000, 12_000)), 1) is None
    one = seen._known(hashed([*range(10_000, 12_000), 77]), 1)
    assert [r.first_key for r in one.collect()] == [77]
    files = {f.split("/hashes/")[1].rsplit("/", 1)[0] for f in one.inputFiles() if "/hashes/" in f and "/batch=" in f}
    scanned = one._jdf.queryExecution().executedPlan().toString()
    assert len(files) == 64 and "PartitionFilters" in scanned and "bucket" in scanned.split("PartitionFilters")[1][:200]


def test_a_full_filter_stays_exact(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i % 300}") for i in range(900)], "id long, text string")
    seen = flows.SeenTexts(spark, "id", str(tmp_path / "seen"), words=2)
    for batch in range(3):
        seen.update(rows.filter(F.col("id") % 3 == batch), batch)
    first = {}
    for batch in range(3):
        for i in range(batch, 900, 3):
            first.setdefault(i % 300, i)
    assert {r.id for r in seen.table().collect() if not r.is_duplicate} == set(first.values())


def test_one_batch_equals_batch_duplicates(spark, tiny):
    df = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    seen = flows.SeenTexts(spark, "doc_id")
    seen.update(df, 0)
    assert sorted(seen.table().collect(), key=repr) == sorted(docs.mark_duplicates(df, "doc_id").collect(), key=repr)


def test_rollup_emits_closed_windows(spark, parts, tmp_path):
    rows = [(i % 2, T0 + timedelta(seconds=i), float(i), 1.0, 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "host long, timestamp timestamp, cpu_percent double, memory_percent double, disk_percent double")
    out = flows.run_available(flows.metric_rollup(parts(df, 1), "5 seconds", "60 seconds"), str(tmp_path / "out"))
    got = {(r.host, r.window_start): (r.cpu_avg, r.cpu_peak, r.samples) for r in out.collect()}
    start = T0.replace(tzinfo=None)
    assert got[0, start] == (2.0, 4.0, 3) and got[1, start] == (2.0, 3.0, 2)
    assert max(k[1] for k in got) == start + timedelta(seconds=50)


def test_alerts(spark, parts, tmp_path):
    df = spark.createDataFrame([(1, 90.0, 1.0, 1.0), (2, 1.0, 1.0, 1.0), (3, 1.0, 1.0, 95.0)], "id long, cpu_percent double, memory_percent double, disk_percent double")
    out = flows.run_available(flows.alerts(parts(df)), str(tmp_path / "out"))
    assert sorted((r.id, r.status) for r in out.collect()) == [(1, "warning"), (3, "critical")]


def test_micro_batches_flush_the_remainder(spark, parts, tmp_path):
    items = spark.range(25).select(F.col("id").alias("item_id"), F.lit("t").alias("batch_type"), F.lit(T0).alias("created_at"), F.lit(1.0).alias("seconds"))
    sizes = []
    log = str(tmp_path / "log")
    flows.micro_batches(parts(items, 2), lambda cut, trigger: sizes.append(cut.count()), log, size=10)
    rows = spark.read.parquet(log).collect()
    assert sum(sizes) == 25 == sum(r["items"] for r in rows) and max(r["items"] for r in rows) == 10
    assert mx.batch_statistics(spark.read.parquet(log)).first().total_processed == 25


def test_ingest(spark, parts, tmp_path):
    good = {"url": "https://a.b", "title": "A title (x)", "headings": ["head one"], "paragraphs": ["p" * 30]}
    lines = [json.dumps(good), "{bad", json.dumps({**good, "url": "nope"}), json.dumps(good)]
    stream = parts(spark.createDataFrame(list(enumerate(lines)), "id long, value string"))
    clean, rejected = str(tmp_path / "clean"), str(tmp_path / "rejected")
    flows.ingest(stream, clean, rejected)
    kept = spark.read.parquet(clean).collect()
    assert sorted(r.id for r in kept) == [0, 3] and kept[0].title == "A title x" and kept[0].status == "completed"
    assert {r.id: r.problem for r in spark.read.parquet(rejected).collect()} == {1: "malformed JSON", 2: "invalid URL"}
