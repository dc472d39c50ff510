import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from checks import views
from pagemill.functions import urls
from pagemill.operators import elements as el

PLAIN = '<html lang="en"><head><title>a &amp; b</title><!-- c --></head><body><P Class="main"\nid="x">t<br></p><video controls poster="p"></video></body></html>'
BITS = [
    "<p>", "</p>", "<b", "<div class='x'>", '<div class="main content">', "<p class = x>", "<br/>", "<img src=a b>", '<a href="x&amp;y">t</a>', '<a\nhref="u"\tTITLE="T&copy">',
    "& &amp; &#65 &lt", "<!-- c -->", "<!--", "<!doctype html>", "<![CDATA[hi]]>", "<![foo[x]]>", "<?pi x>", "<", "</", "</ p>", "</p x>", "<script>a<b</script>", "<script>",
    '<script type="application/ld+json">{"a":"</b>"}</SCRIPT >', "<style>x{}</style >", "</table>", "<table><tr><td>a</td></table>", "<ul><li>a<li>b</ul>", "<1>", '<a href="q', '">',
    " text ", " é", '<video controls><source src="v"></video>', "<nav>", "</nav>", "<script/>", "<p/>", '<P CLASS="A" class="b">', "<textarea><b></textarea>", "<title>x<y</title>",
    '<a href="x"title="y">', '<a  b="c" >', '<o:p a:b="c">', "\x00", '<a="b">', '<li id="main">', '<a b="<p>">', "<a b>", '<A B="">',
]


def test_plain_tags_are_read_by_one_match_each(monkeypatch):
    rows = el.read_page(PLAIN)

    def refuse(self, at):
        raise RuntimeError("read bit by bit")

    for method in ("parse_starttag", "parse_endtag"):
        monkeypatch.setattr(HTMLParser, method, refuse)
    assert el.read_page(PLAIN) == rows and [r["tag"] for r in rows[0]] == ["html", "title", "p", "video"]


def test_plain_tags_and_texts_are_read_in_one_loop(monkeypatch):
    page = '<html lang="en"><title>a &amp; b</title><P Class="main" id="x">t<br>u</p><table><tr><td>c</table><nav>n</nav><p>v <b>w</b><nav>z</nav></html>'
    rows, pieces, body, _ = el.read_page(page)

    def refuse(self, *of):
        raise RuntimeError("read by a call each")

    for method in ("handle_starttag", "handle_endtag", "handle_data"):
        monkeypatch.setattr(el.TagReader, method, refuse)
    assert el.read_page(page) == (rows, pieces, body, None) and pieces == ["a & b", "t", "u", "c", "n", "v ", "w", "z"]
    assert rows[-1]["measure"]["words"] == 2 and rows[-1]["body_measure"]["words"] == 2


def test_texts_that_nothing_measures_are_not_indexed():
    reader = el.TagReader()
    reader.feed("<title>a</title><p>b</p>" + "<b>c</b>" * 50)
    reader.finish()
    assert len(reader.text.pieces) == 52 and len(reader.text.chars) == 3 and reader.body.chars == [0]


@pytest.mark.parametrize("every", [False, True])
def test_any_markup_gives_the_rows_of_the_parsers_own_loop(monkeypatch, every):
    rng = random.Random(3)
    pages = [PLAIN, *("".join(rng.choices(BITS, k=rng.randint(1, 25))) for _ in range(3000))]
    found = [el.read_page(page, every) for page in pages]
    monkeypatch.setattr(el.TagReader, "goahead", HTMLParser.goahead)
    wrong = [page for page, rows in zip(pages, found) if el.read_page(page, every) != rows]
    assert not wrong, wrong[:3]


def test_a_path_is_folded_once_per_reference(spark):
    df = spark.createDataFrame([("https://h/a/b", "../c")], "b string, h string").select(urls.resolve_url(F.col("b"), F.col("h")).alias("u"))
    assert df._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert df.first().u == "https://h/c"


def test_product_pages_spread_by_their_number(spark, tmp_path):
    n = 4 * views.PAGES_PER_TASK + 1
    part = spark.range(n).select(F.col("id").alias("p_partkey"), *[F.lit("x").alias(c) for c in ("p_name", "p_brand", "p_type")], F.lit(1).alias("p_size"))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pages = views.catalog_pages(spark, str(tmp_path))
    assert pages.rdd.getNumPartitions() > 4 and pages.count() == n
