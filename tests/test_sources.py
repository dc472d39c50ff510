import json
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagemill.operators import crawl
from pagemill.sources import readers, writers

def page(url, words, links):
    """A stored page record with counts that follow from its lists."""
    paragraphs = [" ".join([w] * 6) for w in words]
    return {
        "url": url, "title": words[0].title(), "headings": words[:2], "paragraphs": paragraphs,
        "links": [{"url": u, "text": u[-1]} for u in links], "images": [], "meta": {"robots": "all"},
        "content_length": 100 * len(words), "headings_count": len(words[:2]), "paragraphs_count": len(words),
        "links_count": len(links), "images_count": 0, "scraped_at": "2031-02-03T04:05:06.070809",
    }


def crawl_result(pages):
    total = lambda name: sum(p[name] for p in pages)
    return {
        "base_url": "https://herbs.example", "pages_scraped": len(pages), "total_time": 0.25, "depth": 3, "max_pages": 9, "pages": pages,
        "summary": {"total_headings": total("headings_count"), "total_paragraphs": total("paragraphs_count"), "total_links": total("links_count"),
                    "total_images": 0, "total_content_length": total("content_length")},
        "scraped_at": "2031-02-03T04:05:07.000001",
    }


def test_crawl_results(spark, tmp_path):
    basil, thyme = page("https://herbs.example/basil", ["basil", "leaf", "pesto"], ["https://x.example/p", "/q"]), page("https://herbs.example/thyme", ["thyme"], [])
    for name, pages in (("one", [basil]), ("two", [basil, thyme])):
        (tmp_path / f"{name}.json").write_text(json.dumps(crawl_result(pages), indent=1))
    results = readers.crawl_results(spark, str(tmp_path))
    assert sorted(r.pages_scraped for r in results.collect()) == [1, 2]
    pages = readers.crawl_pages(results).withColumn("crawl_id", F.col("base_url"))
    totals = crawl.crawl_summary(pages).first()
    assert (totals.total_pages, totals.total_headings, totals.total_links, totals.total_content_length) == (3, 5, 4, 700)
    assert {r.meta["robots"] for r in pages.collect()} == {"all"}
    assert sorted(tuple(r) for r in results.select("summary.*").collect()) == [(2, 3, 2, 0, 300), (3, 4, 2, 0, 400)]


def test_html_files(spark, tmp_path):
    (tmp_path / "p.html").write_text("<title>x</title>\n<p>y</p>")
    row = readers.page_corpus(spark, str(tmp_path), html_files=True).first()
    assert row.html.startswith("<title>") and row.url.endswith("p.html")


def test_structured_log(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"timestamp": "2024-01-01T00:00:00.5", "level": "INFO", "message": "m", "duration": 1.5, "exception": "E"}\nnot json\n')
    rows = readers.structured_log(spark, str(tmp_path)).collect()
    assert rows[0].duration == 1.5 and rows[0].path is None and rows[0].exception == "E" and rows[1].level is None


def test_submissions(spark):
    good = {"url": "https://a.b", "title": "t", "headings": ["h"], "paragraphs": []}
    lines = [json.dumps(good), json.dumps({**good, "url": "x"}), json.dumps({k: good[k] for k in ("url", "title", "headings")}), "{", json.dumps({**good, "headings": "no"})]
    checked = readers.submissions(spark.createDataFrame(list(enumerate(lines)), "id long, value string"))
    assert [r.problem for r in checked.orderBy("id").collect()] == [None, "invalid URL", "missing paragraphs", "malformed JSON", "malformed JSON"]
    ok, bad = readers.good_and_bad(checked)
    assert ok.count() == 1 and bad.count() == 4 and "raw" in bad.columns


@pytest.fixture
def processed(spark):
    item = "struct<url:string,title:string,headings:array<string>,meta:map<string,string>>"
    rows = [("a", [("u1", 'T, "q"', ["h1", "é"], {"k": "v"}), ("u2", "T2", [], {})]), ("b", [("u3", None, None, None)])]
    return spark.createDataFrame(rows, f"id string, data array<{item}>")


def test_export_job(spark, processed, tmp_path):
    wanted = spark.createDataFrame([(0, "b"), (1, "a"), (2, "missing"), (3, "b")], "position long, id string")
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    manifest = str(tmp_path / "manifest")
    for fmt in ("json", "csv", "excel"):
        writers.append_rows(writers.export(wanted, processed, fmt, "me", str(tmp_path), at), manifest)
    rows = {r.format: r for r in writers.read_manifest(spark, manifest).collect()}
    assert (rows["json"].record_count, rows["json"].status) == (4, "completed")
    assert (rows["excel"].record_count, rows["excel"].status, rows["excel"].error) == (0, "failed", "Unsupported format: excel")
    files = sorted(Path(rows["json"].file_path).glob("part-*"))
    lines = [json.loads(line) for f in files for line in f.read_text(encoding="utf-8").splitlines()]
    assert [line["url"] for line in lines] == ["u3", "u1", "u2", "u3"] and lines[0]["title"] is None
    assert "é" in "".join(f.read_text(encoding="utf-8") for f in files)
    back = spark.read.option("header", True).option("escape", '"').csv(rows["csv"].file_path)
    assert back.columns == ["url", "title", "headings", "meta"]
    assert back.filter("url = 'u1'").first()[:] == ("u1", 'T, "q"', '["h1","é"]', '{"k":"v"}')


def test_compression_is_the_callers_choice(spark, tmp_path):
    for codec, zipped in (("none", False), ("gzip", True)):
        path = tmp_path / codec
        writers.compressed_json(spark.range(11), str(path), codec)
        assert bool(list(path.glob("*.gz"))) is zipped and spark.read.json(str(path)).count() == 11


def test_a_failed_export_leaves_no_files(spark, processed, tmp_path):
    broken = processed.withColumn("data", F.transform("data", lambda d: d.withField("url", F.raise_error(F.lit("no disk")).cast("string"))))
    wanted = spark.createDataFrame([(0, "a")], "position long, id string")
    row = writers.export(wanted, broken, "json", "7", str(tmp_path)).first()
    assert row.status == "failed" and row.file_path is None and not list(tmp_path.iterdir())


def test_status_of_equal_times(spark):
    rows = [("a", "completed", 1, None), ("a", "processing", 1, None), ("b", "failed", 2, "x"), ("b", "completed", 2, None)]
    df = spark.createDataFrame(rows, "id string, processing_status string, updated_at long, error string")
    assert {r.id: r.processing_status for r in writers.current_status(df).collect()} == {"a": "completed", "b": "failed"}


def test_metric_entry_and_status(spark, tmp_path):
    df = spark.createDataFrame([("t", {"status": "ok", "duration": "1.5", "user": "x", "response_time": "bad"})], "id string, m map<string,string>")
    row = df.select(readers.metric_entry(F.col("id"), F.col("m"), F.current_timestamp()).alias("e")).first().e
    assert (row.status, row.duration, row.response_time, row.extra) == ("ok", 1.5, None, {"user": "x"})
    times = spark.createDataFrame([("2024-01-01T10:00:00.25",), ("junk",)], "timestamp string")
    assert [r[0] is not None for r in readers.with_iso_time(times).collect()] == [True, False]
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    events = writers.status_events(docs, "processing", at(1)).unionByName(writers.status_events(docs.filter("id = 'a'"), "failed", at(2), F.lit("boom")))
    got = {r.id: (r.processing_status, r.error) for r in writers.current_status(events).collect()}
    assert got == {"a": ("failed", "boom"), "b": ("processing", None)}
