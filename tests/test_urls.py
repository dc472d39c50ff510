import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls

NORMALIZED = [
    ("HTTPS://WWW.Ex.com/a/b//?z=1&a=2#f", "https://ex.com/a/b?z=1&a=2"),
    ("http://example.com", "http://example.com/"),
    ("  http://example.com/#x ", "http://example.com/"),
    ("http://www./a", "http://www./a"),
    ("//host/x", "https://host/x"),
    ("host/x", "https://host/x"),
    ("mailto:a@b.c", "mailto:a@b.c"),
    ("http://h/a b/?q", "http://h/a b?q"),
    ("http://h/p?", "http://h/p"),
    ("http://h/a/;p", "http://h/a;p"),
]


def test_normalize(one):
    got = one([u for u, _ in NORMALIZED], lambda v: urls.normalize_url(F.col(v)))
    assert got == [want for _, want in NORMALIZED]


def test_valid(one):
    cases = {
        "http://a.b/c": True, "https://a.b": True, "ftp://a.b": False, "not-a-valid-url": False,
        "http:///x": False, "": False, "HTTP://a.b": True, None: False,
    }
    assert one(list(cases), lambda v: urls.is_valid_url(F.col(v))) == list(cases.values())
    on = ["http://www.Site.com/x", "http://other.com", "site.com"]
    assert one(on, lambda v: urls.is_valid_url(F.col(v), "site.com")) == [True, False, False]


def test_exclude(one):
    cases = {
        "http://a/x.PDF": True, "http://a/x.pdf?y": False, "http://a/x.docx": True, "http://a/x.tar.gz": True,
        "http://a/x.gz": False, "http://a/x.mp4": True, "http://a/x.mp5": False, "mailto:x@y": True, "http://a/tel:1": True,
        "http://a/b.jpeg": True, "http://a/": False,
    }
    assert one(list(cases), lambda v: urls.should_exclude_url(F.col(v))) == list(cases.values())


def test_default_scheme(one):
    assert one(["a.b", "http://a", "https://a"], lambda v: urls.default_scheme(F.col(v))) == ["https://a.b", "http://a", "https://a"]


HREFS = [
    "x", "x/y", "./x", "../x", "../../../x", "/x", "/x/../y/./z", "/..", "..", ".", "?q=1", "#f", "?q#f", "//h2/p", "http://o/p",
    "https://o/p", "mailto:a@b", "x;p?q#f", "", "a//b", "/a//b", "g;x=1/../y", "tel:1", "x y", "javascript:void(0)",
]
BASES = ["http://a/b/c/d?q", "http://a", "http://a/", "https://a.b/c/", "http://a/b//c", "http://a/b/c;p?q#f"]


def test_resolve_equals_the_standard_library(spark):
    pairs = [(b, h) for b in BASES for h in HREFS]
    rng = random.Random(7)
    parts = ["a", "b", "..", ".", "", "c.html", "?x=1", "#y", ";p"]
    for _ in range(400):
        pairs.append((rng.choice(BASES), "/".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))))
    df = spark.createDataFrame(pairs, "b string, h string")
    wrong = [
        (r.b, r.h, r.got, urljoin(r.b, r.h))
        for r in df.withColumn("got", urls.resolve_url(F.col("b"), F.col("h"))).collect()
        if r.got != urljoin(r.b, r.h)
    ]
    assert not wrong, wrong[:10]


def test_parts_equal_the_standard_library(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet").select("url", urls.split_url(F.col("url")).alias("p"))
    for row in pages.collect():
        want = urlsplit(row.url)
        assert (row.p.scheme, row.p.netloc, row.p.path, row.p.query, row.p.fragment) == tuple(want)


@pytest.mark.parametrize(
    "url,base,kind",
    [("http://a/x", "http://a/y", "internal"), ("http://b/x", "http://a/y", "external"), ("mailto:x@y", "http://a/", "relative")],
)
def test_link_type(spark, url, base, kind):
    df = spark.createDataFrame([(url, base)], "u string, b string")
    assert df.select(urls.link_type(F.col("u"), F.col("b"))).first()[0] == kind
