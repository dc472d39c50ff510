"""Folders of many files, read and written by tasks, against Spark's own readers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.sources import files, readers

NAMES = ["a.html", "b c.html", "d%20.html", "é,=+.html", "x[1]{2}.html", "_kept=1.html", "_not", ".not", "late._COPYING_", "q?#.html", "~'()!@;&$.txt"]


@pytest.fixture
def folder(tmp_path):
    for at in ("", "in/ner ü", "k=1", "_hidden", ".hidden"):
        (tmp_path / at).mkdir(parents=True, exist_ok=True)
        for name in NAMES:
            (tmp_path / at / name).write_bytes(f"<p>{at}/{name}\n\nend".encode() + b"\xff\xc3")
        (tmp_path / at / "empty.html").write_bytes(b"")
        (tmp_path / at / "packed.html.gz").write_bytes(gzip.compress(at.encode() + b"packed\n"))
        (tmp_path / at / "packed[2].html.gz").write_bytes(gzip.compress(b"p" * 9))
    return str(tmp_path)


def test_folders_are_read_as_by_spark(spark, folder):
    own = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name(), F.hex(F.encode("value", "utf-16")), F.length("value"))
    got = readers.page_corpus(spark, folder, html_files=True).select("url", F.hex(F.encode("html", "utf-16")), F.length("html"))
    want = sorted(map(tuple, own.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 3 * 10
    one = readers.page_corpus(spark, f"{folder}/a.html", html_files=True).collect()
    some = readers.page_corpus(spark, f"{folder}/k=*/*.txt", html_files=True).collect()
    assert len(one) == len(some) == 1


def test_the_driver_lists_no_files(spark, tmp_path):
    """A folder of its own for each file, as many as the driver would hold names of."""
    for i in range(40):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}" / "p.html").write_text(f"<p>{i}")
    pages = readers.page_corpus(spark, str(tmp_path), html_files=True)
    assert sorted(r.html for r in pages.collect()) == sorted(f"<p>{i}" for i in range(40))
    assert not [f for f in pages.inputFiles() if f.endswith(".html")]


def test_files_are_written_by_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDER_FILES", 5)
    rows = [(f"page_id={i}.html", f"<p>{i}\né") for i in range(60)] + [("page_id=7.html", "again"), ("page_id=8.html", None), ("none", None)]
    df = spark.createDataFrame(rows, "file string, value string").repartition(3)
    path = f"{tmp_path}/made"
    assert files.write_files(df, path) == 61
    got = {r.url.rsplit("/", 1)[1]: r.html for r in readers.page_corpus(spark, path, html_files=True).collect()}
    assert len(got) == 61 and got["page_id=9.html"] == "<p>9\né\n" and got["none"] == "\n"
    assert sorted(got["page_id=7.html"].split("\n")) == ["", "<p>7", "again", "é"]


def test_objects_are_parsed_as_by_spark(spark, tmp_path):
    page = {"base_url": "https://a.é", "pages_scraped": 2, "pages": [{"url": "u", "title": "t\n", "headings": ["h"]}]}
    texts = {
        "one": json.dumps(page, indent=2), "many": json.dumps([page, page]), "two": json.dumps(page) + "\n" + json.dumps(page), "broken": '{"base_url": "x", ',
        "blank": " \n", "empty": "", "number": "7", "wrong": '{"base_url": ["x"], "pages_scraped": "no"}', "list": "[]",
    }
    for at in ("", "in/ner"):
        (tmp_path / at).mkdir(parents=True, exist_ok=True)
        for name, text in texts.items():
            (tmp_path / at / f"{name}.json").write_text(text, encoding="utf-8")
        (tmp_path / at / "wide.json").write_bytes(json.dumps(page, ensure_ascii=False).encode("utf-16"))
        (tmp_path / at / "mark.json").write_bytes(json.dumps(page, ensure_ascii=False).encode("utf-8-sig"))
        (tmp_path / at / "bad.json").write_bytes(b'{"base_url": "\xff\xfe"}')
        (tmp_path / at / "packed.json.gz").write_bytes(gzip.compress(json.dumps(page).encode()))
    own = spark.read.schema(schemas.CRAWL_RESULT).json(str(tmp_path), multiLine=True, recursiveFileLookup=True)
    got = readers.crawl_results(spark, str(tmp_path), folders=True)
    rows = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    assert rows(got) == rows(own) and len(rows(own)) > 12 and got.schema == own.schema
