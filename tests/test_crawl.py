import pytest
from pyspark.sql import functions as F

from pagemill.operators import crawl


@pytest.fixture
def walk(spark):
    def run(edges, seeds, depth, max_pages, **kw):
        links = spark.createDataFrame(edges, "src string, dst string")
        roots = spark.createDataFrame(seeds, "crawl_id long, url string")
        return sorted((r.crawl_id, r.level, r.url) for r in crawl.breadth_first(links, roots, depth, max_pages, **kw).collect())

    return run


EDGES = [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")]


def test_levels(walk):
    assert walk(EDGES, [(1, "a")], 1, 10) == [(1, 0, "a")]
    assert walk(EDGES, [(1, "a")], 9, 99) == [(1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (1, 2, "d"), (1, 3, "e")]


def test_a_level_is_never_cut(walk):
    assert walk(EDGES, [(1, "a")], 9, 2) == [(1, 0, "a"), (1, 1, "b"), (1, 1, "c")]
    assert walk(EDGES, [(1, "a")], 9, 1) == [(1, 0, "a")]


def test_many_crawls_at_once(walk):
    assert walk(EDGES, [(1, "d"), (2, "x"), (3, "none")], 3, 10) == [(1, 0, "d"), (1, 1, "e"), (2, 0, "x"), (2, 1, "y"), (3, 0, "none")]


def test_stored_pages_and_prefix(walk, spark):
    pages = spark.createDataFrame([("a",), ("c",), ("d",)], "url string")
    assert walk(EDGES, [(1, "a")], 9, 99, pages=pages) == [(1, 0, "a"), (1, 1, "c"), (1, 2, "d")]
    edges = [("http://s", "http://s/1"), ("http://s", "http://t/1"), ("http://s/1", "http://s/2")]
    assert [r[2] for r in walk(edges, [(1, "http://s")], 9, 99, same_prefix=True)] == ["http://s", "http://s/1", "http://s/2"]


def test_bad_bounds(walk):
    with pytest.raises(ValueError):
        walk(EDGES, [(1, "a")], 0, 1)


def test_bounded_crawl(spark):
    links = spark.createDataFrame(
        [("http://s/", i, d) for i, d in enumerate(["http://s/b", "http://t/x", "http://s/a", "http://s/b", "http://s/", "http://s/c"])] + [("http://s/b", 0, "http://s/z")],
        "src string, link_seq long, dst string")
    seeds = spark.createDataFrame([(1, "http://s/")], "crawl_id long, url string")
    urls = lambda n, depth=2: [r.url for r in crawl.bounded_crawl(links, seeds, n, depth).orderBy("position").collect()]
    assert urls(3) == ["http://s/", "http://s/b", "http://s/a"]
    assert urls(99) == ["http://s/", "http://s/b", "http://s/a", "http://s/c"]
    assert urls(99, 1) == urls(1) == ["http://s/"]


def test_outcomes(spark):
    rows = [(1, "http://a", 200), (2, "http://www.a/#x", 200), (3, "http://b/x.pdf", 200), (4, "http://b/x.pdf", 200),
            (5, "http://c", 404), (6, "http://c", 200), (7, "http://d", 403), (8, "http://e", 500), (9, "http://f", 418)]
    got = {r.seq: (r.url, r.error, r.status_code) for r in crawl.outcomes(spark.createDataFrame(rows, "seq long, url string, status_code long"), "seq").collect()}
    assert got == {
        1: ("http://a/", None, 200), 2: ("http://www.a/#x", "Already visited", None), 3: ("http://b/x.pdf", "URL excluded by pattern", None),
        4: ("http://b/x.pdf", "URL excluded by pattern", None), 5: ("http://c/", "Page not found", 404), 6: ("http://c", "Already visited", None),
        7: ("http://d/", "Access forbidden", 403), 8: ("http://e/", "Server error", 500), 9: ("http://f/", "HTTP 418", 418),
    }


def test_summary_and_report(spark):
    pages = spark.createDataFrame([(1, ["h"], [], [], [], 5, 9, 0, 0, 10)], "crawl_id long, headings array<string>, paragraphs array<string>, links array<string>, images array<string>, headings_count long, paragraphs_count long, links_count long, images_count long, content_length long")
    assert crawl.crawl_summary(pages).first()[:] == (1, 1, 5, 9, 0, 0, 10)
    assert crawl.crawl_summary(pages, capped=True).first()[:] == (1, 1, 1, 0, 0, 0, 10)
    wanted = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "run_id long, url_no long, url string")
    results = spark.createDataFrame([("a", None), ("b", "boom")], "url string, error string")
    detail, totals = crawl.run_report(wanted, results)
    assert {r.url: (r.status, r.error) for r in detail.collect()} == {"a": ("completed", None), "b": ("failed", "boom"), "c": ("failed", "No result")}
    assert totals.first()[:] == (1, "completed", 3, 1, 2)


def test_hubs_are_followed_in_blocks(walk, spark, monkeypatch):
    """A page with 30 % of all links: the same levels, and no block above its share."""
    edges = [("hub", f"p{i}") for i in range(600)] + [(f"p{i}", f"p{(i * 7) % 600}") for i in range(600)] + [(f"p{i}", f"q{i}") for i in range(800)] + [("start", "hub")]
    want = walk(edges, [(1, "start"), (2, "p3")], 4, 5000)
    assert sum(1 for c, level, _ in want if (c, level) == (1, 2)) == 600
    monkeypatch.setattr(crawl, "LINKS_OF_A_TASK", 50)
    assert walk(edges, [(1, "start"), (2, "p3")], 4, 5000) == want
    placed, hubs = crawl.split_adjacency(spark.createDataFrame(edges, "src string, dst string"))
    assert [tuple(r) for r in hubs.collect()] == [("hub", 12)]
    sizes = [r["count"] for r in placed.filter("src = 'hub'").groupBy("block").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 100
