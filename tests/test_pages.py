import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import elements as el, pages as pg

GARDEN = (
    "<!doctype html><title> Winter garden </title><meta property='og:type' content='guide'>"
    "<h2>Tools</h2><h1>Beds</h1><p>Cover the beds with straw in late autumn.<p>Water now."
    "<div><a href='https://seeds.example/beans'>Beans &amp; peas</a> <a href='/local'>Local</a></div>"
    "<img alt='A spade' src='img/spade.png' title='Spade'><img alt='nothing'>"
)


@pytest.fixture
def extract(spark):
    def run(html, profile="enhanced", url="http://www.Site.com/dir/page.html", **kw):
        df = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
        return pg.extract(df, profile, **kw).first()

    return run


def test_stored_page(extract):
    row = extract(GARDEN, "basic")
    assert row.title == "Winter garden" and row.headings == ["Beds", "Tools"]
    # the unclosed first paragraph holds all that follows, the second one too
    assert row.paragraphs[0].startswith("Cover the beds with straw in late autumn.Water now.Beans & peas") and len(row.paragraphs) == 2
    assert [tuple(link) for link in row.links] == [("https://seeds.example/beans", "Beans & peas")]
    assert [(i.src, i.alt, i.title) for i in row.images] == [("http://www.Site.com/dir/img/spade.png", "A spade", "Spade")]
    assert row.meta == {"og:type": "guide"}
    assert row.content_length == len(GARDEN)


def test_response_fields_of_enhanced_records(spark):
    df = spark.createDataFrame([("http://a.b/", "<p>x", {"content-type": "text/html", "last-modified": "Mon"})], "url string, html string, headers map<string,string>")
    row = pg.extract(df, "enhanced").first()
    assert (row.content_type, row.last_modified, row.http_headers.etag) == ("text/html", "Mon", "")


@pytest.mark.parametrize("profile,title", [("basic", "No title"), ("api", "No title found"), ("enhanced", "A heading")])
def test_missing_title(extract, profile, title):
    assert extract("<h1> A  heading </h1>", profile).title == title


def test_boundaries(extract):
    p = lambda n: "<p>" + "x" * n + "</p>"
    words = "<p>" + "abcdefg " * 4 + "</p><p>" + "abcdefg " * 5 + "</p>"
    html = p(20) + p(21) + p(30) + words + "<h1>one</h1><h1>two words</h1><h2>ab</h2><h3>abc</h3>"
    assert [len(t) for t in extract(html, "basic").paragraphs] == [21, 30, 31, 39]
    row = extract(html, "enhanced")
    assert [len(t) for t in row.paragraphs] == [39]  # over 30 characters and five words
    assert [h.text for h in row.headings] == ["two words"]
    assert extract(html, "api").headings == ["one", "two words", "abc"]
    assert extract(html, "basic").headings == ["one", "two words", "ab", "abc"]


def test_heading_order(extract):
    html = "<h2>second level</h2><h1>first level</h1>"
    assert extract(html, "api").headings == ["second level", "first level"]
    assert extract(html, "basic").headings == ["first level", "second level"]
    assert [(h.level, h.tag) for h in extract(html, "enhanced").headings] == [(1, "h1"), (2, "h2")]


def test_lenient_tree(extract):
    row = extract("<p>outer text that is long <b>bold<p>inner text that is long</p></i> tail</body>", "basic")
    assert row.paragraphs == ["outer text that is long boldinner text that is long tail", "inner text that is long"]
    row = extract("<p>text<br/>more text of the page<script>var p='</p>';</script><!-- no --> end</p>", "basic")
    assert row.paragraphs == ["textmore text of the page end"]
    assert extract("<p/>after the empty paragraph here", "basic").paragraphs == []
    assert extract(None, "basic").title == "No title"


def test_boilerplate(extract):
    html = (
        "<header><h1>Site name here</h1></header><nav><a href='/n'>Nav</a></nav>"
        "<p>A paragraph with <nav>hidden words</nav> enough words to keep.</p><a href='/x'>Link</a>"
        "<footer><img src='f.png'></footer>"
    )
    row = extract(html)
    assert row.headings == [] and [k.url for k in row.links] == ["http://site.com/x"] and row.images == []
    assert row.paragraphs == ["A paragraph with enough words to keep."]
    whole = extract(html, drop_boilerplate=False)
    assert [k.url for k in whole.links] == ["http://site.com/n", "http://site.com/x"] and len(whole.images) == 1


def test_links(extract):
    html = "".join(f"<a href='{h}'>{t}</a>" for h, t in [
        ("/a#x", "One"), ("http://www.site.com/a/", "Dup"), ("#top", "Top"), (" ", "Blank"), ("mailto:a@b", "Mail"),
        ("../up", "Up"), ("https://other.org", ""), ("httpx://odd", "Odd"),
    ])
    row = extract(html)
    assert [(k.url, k.text, k.type) for k in row.links] == [
        ("http://site.com/a", "One", "internal"), ("mailto:a@b", "Mail", "relative"), ("http://site.com/up", "Up", "internal"),
        ("https://other.org/", "", "external"), ("httpx://odd/", "Odd", "external"),
    ]
    assert [k.url for k in extract(html, "api").links] == ["http://www.Site.com/a#x", "http://www.site.com/a/"]
    assert [k.url for k in extract(html, "basic").links] == ["http://www.site.com/a/", "https://other.org", "httpx://odd"]


def test_records_are_whole_unless_capped(extract):
    html = "".join(f"<h1>heading {i}</h1><a href='http://x/{i}'>t{i}</a>" for i in range(120))
    for profile in pg.PROFILES:
        row = extract(html, profile)
        assert (len(row.headings), len(row.links), row.headings_count, row.links_count) == (120, 120, 120, 120)
    for profile, heads, links in [("basic", 20, 100), ("api", 20, 50), ("crawl", 15, 30)]:
        row = extract(html, profile, caps=pg.CAPS[profile])
        assert (len(row.headings), len(row.links), row.headings_count, row.links_count) == (heads, links, 120, 120)
    long = f"<a href='http://x/'>{'t' * 300}</a>"
    assert len(extract(long, "basic").links[0].text) == 300
    assert len(extract(long, "basic", text_cap=pg.LINK_TEXT_CAP).links[0].text) == 100


def test_metadata(extract):
    html = """<html lang=" en "><meta charset=" utf-8 "><meta name="A" content="1"><meta name="a" content=" 2 "><meta property="og:t" content="x">
    <meta property="og:t" content="y"><meta property="og:" content="z"><meta name="twitter:c" content="s"><meta name="empty" content="">
    <link rel="nofollow canonical" href="/c"><link rel="icon" href="i.ico"><script type="application/ld+json">[1, {"k": null}]</script>
    <script type="application/ld+json">{oops</script><script type="application/ld+json"></script>"""
    row = extract(html, "api")
    assert row.meta == {"a": "2", "og:t": "y", "og:": "z", "twitter:c": "s"}
    assert row.open_graph == {"t": "y"} and row.twitter == {"c": "s"}
    assert [v.toJson() for v in row.json_ld] == ['[1,{"k":null}]']
    assert row.attributes.asDict() == {
        "canonical_url": "/c", "favicon": "i.ico", "language": "en", "charset": "utf-8", "viewport": None, "robots": None}
    assert extract(html, "basic").meta == {"A": "1", "a": " 2 ", "og:t": "y", "og:": "z", "twitter:c": "s"}
    assert extract(html).meta["a"] == " 2 "


def test_media(extract):
    row = extract("<video controls autoplay><source src='a.mp4' type='t'><source src=' '></video><video></video><img src='//cdn/x.png' width='5'>")
    assert [([(s.src, s.type) for s in v.sources], v.poster, v.controls, v.autoplay) for v in row.videos] == [
        ([("http://site.com/dir/a.mp4", "t")], "", True, True)]
    assert [(i.src, i.width, i.height, i.loading) for i in row.images] == [("http://cdn/x.png", "5", None, "eager")]


def test_lists_and_tables(extract):
    row = extract(
        "<ul><li>a<ol><li>b</li></ol></li><li> </li></ul><ul></ul>"
        "<table><tr><td>1</td><td></td></tr><tr></tr><tr><td><table><tr><th>n</th></tr></table></td></tr></table><table></table>"
    )
    assert [(b.type, b["items"]) for b in row.lists] == [("ul", ["ab", "b"]), ("ol", ["b"])]
    assert [t.rows for t in row.tables] == [[["1", ""], ["n", "n"], ["n"]], [["n"]]]


def test_main_content_priority(extract):
    para = "<p>This paragraph has more than five words in it.</p>"
    assert extract("<div id='main'>low rank</div><div class='x content'>higher rank</div>").main_content == "higher rank"
    assert extract("<article>second</article><main>first</main>").main_content == "first"
    assert extract("<main> </main><article>text</article>" + para).main_content == "This paragraph has more than five words in it."
    long = "<main>" + "y" * 1500 + "</main>"
    assert len(extract(long).main_content) == 1500
    row = extract(long, text_cap=pg.CONTENT_CAP)
    assert len(row.main_content) == 1000 and row.text_length == 1500


def test_web_clean(one):
    cases = {
        "Skip to content": "", "Home": "", "Homeward bound": "Homeward bound", "  © 2024 all": "", "Copyright 2020": "",
        "Follow us now": "", "a \n b": "a b", None: "", "contact us": "contact us", "go to  the": "",
    }
    assert one(list(cases), lambda v: pg.clean_web_text(F.col(v))) == list(cases.values())


def test_quality(spark):
    rows = [("x" * 11, 501, 1, 4, 1000, 1.0), ("x" * 10, 101, 0, 0, 10000, 0.1), ("", 0, 0, 0, 0, 0.0), ("x" * 11, 201, 1, 1, 4000, 0.85)]
    df = spark.createDataFrame(rows, "t string, n long, h long, p long, html long, want double")
    score = pg.quality_score(*[F.col(c) for c in ("t", "n", "h", "p", "html")])
    for row in df.withColumn("got", score).collect():
        assert row.got == pytest.approx(row.want)


def test_common_shape(spark):
    df = spark.createDataFrame([(1, "http://s/", "<h2>Two words</h2><h1>Main heading here</h1><a href='/x'>X</a>")], "page_id long, url string, html string")
    row = pg.common_shape(pg.extract(df, "enhanced")).first()
    assert row.headings == ["Main heading here", "Two words"] and set(row.links[0].asDict()) == {"url", "text"}


def test_one_python_step_and_no_shuffle(spark, tiny):
    out = pg.extract(spark.read.parquet(f"{tiny}/pages.parquet"), "enhanced")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "BatchEvalPython" not in plan


def test_reader_keeps_document_order():
    rows, pieces, body, stopped = el.read_page("<title>t</title><p>a<p>b")
    texts = ["".join(pieces[r["text"]["start"] : r["text"]["start"] + r["text"]["size"]]) for r in rows]
    assert stopped is None and body == pieces
    assert [(r["seq"], r["tag"], t) for r, t in zip(rows, texts)] == [(1, "title", "t"), (2, "p", "ab"), (3, "p", "b")]


def test_reader_is_linear_on_unclosed_tags(spark):
    html = "".join(f"<p>word{i} <li>x" for i in range(20_000))
    rows, pieces, _, _ = el.read_page("<ul>" + html)
    assert sum(map(len, pieces)) < len(html) and len(rows) == 20_001 and len(rows[0]["parts"]) == 20_000
    df = spark.createDataFrame([(1, "http://s/", html)], "page_id long, url string, html string")
    parsed = el.with_elements(df)
    assert parsed.select(F.length(F.to_json(F.struct("elements", "text_pieces", "body_pieces"))).alias("n")).first().n < 400 * 20_000
    table = el.element_table(df.withColumn("html", F.lit("<nav>n<p>a</nav><p>b<i>c<p>d")), ["page_id"], tags=["p"])
    assert [(r.text, r.body_text) for r in table.orderBy("seq").collect()] == [("a", "a"), ("bcd", "bcd"), ("d", "d")]


def test_nested_sets(spark):
    html = "<div><p>a<b>c</b><br>d<table><tr><td>e<table><tr><td>f</table></table></div><p>g"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = el.element_table(df, ["page_id"]).orderBy("seq").collect()
    inside = {(a.seq, b.seq) for a in rows for b in rows if a.seq < b.seq <= a.last}
    by_seq, parents = {r.seq: r for r in rows}, {(r.container, r.seq) for r in rows if r.container}
    assert [r.tag for r in rows] == ["div", "p", "b", "br", "table", "tr", "td", "table", "tr", "td", "p"]
    assert parents <= inside and all(len([1 for a, b in inside if b == r.seq]) == r.level for r in rows)
    assert all(by_seq[a].post > by_seq[b].post for a, b in inside) and sorted(r.post for r in rows) == list(range(1, 12))
    assert [r.text for r in rows if r.tag in ("p", "table")] == ["acdef", "ef", "f", "g"]
    assert "text" not in el.element_table(df, ["page_id"], texts=False).columns


def test_measures_equal_joined_texts():
    """Lengths, words and first characters from running sums, for every range of pieces."""
    draw = random.Random(6)
    for _ in range(300):
        index = el.TextIndex()
        for _ in range(draw.randrange(12)):
            index.add("".join(draw.choice([" ", "\n", "\xa0", "a", "b", "\u3000", "é", "word", "x" * 40]) for _ in range(draw.randrange(1, 6))))
        for start in range(len(index.pieces) + 1):
            for stop in range(start, len(index.pieces) + 1):
                text = "".join(index.pieces[start:stop])
                squeezed = " ".join(text.split())
                want = {"chars": len(text.strip()), "squeezed": len(squeezed), "words": len(text.split()), "head": squeezed[: el.HEAD]}
                assert index.measure(start, stop) == want


def test_unclosed_paragraphs_cost_their_page(spark):
    """20,000 unclosed paragraphs: counts, quality and filters need none of their texts."""
    html = "<title>A page of paragraphs</title>" + "".join(f"<p>Paragraph {i} has some words of its own." for i in range(20_000))
    df = spark.createDataFrame([(1, "http://s/", html)], "page_id long, url string, html string")
    for profile in ("basic", "enhanced"):
        out = pg.extract(df, profile)
        row = out.select("paragraphs_count", *(["quality_score", "text_length"] if profile == "enhanced" else [])).first()
        assert row.paragraphs_count == 20_000
    spans = el.with_elements(df).select(pg.paragraph_spans(F.col("elements"), "enhanced", longest=50).alias("s")).first().s
    assert len(spans) == 20_000 and spans[-1].text == "Paragraph 19999 has some words of its own." and spans[0].text is None
    assert spans[0].end - spans[0].start == 20_000 and spans[0].words == 7 * 20_000 + 1  # "own.Paragraph" is one word


def test_spans_are_the_paragraphs(spark):
    html = "<p>Skip to main content of this long page here<nav><p>in the navigation there are words too</nav><p>Copyright 2024 by all who wrote it down<p>home<p> five   words make\n it\xa0 count really <b>more</b>over</p>"
    df = el.with_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    for profile in ("basic", "enhanced"):
        for elements in (F.col("elements"), pg.body_elements(F.col("elements"))):
            row = df.select(pg.paragraphs(elements, profile).alias("p"), pg.paragraph_spans(elements, profile, 10_000).alias("s")).first()
            assert [s.text for s in row.s] == row.p and [s.chars for s in row.s] == list(map(len, row.p))


def test_many_tables_videos_and_keys(spark):
    """3,000 tables with a row each, 3,000 videos with a source each, 3,000 keys given twice: each item is met once."""
    n = 3000
    html = "".join(f"<table><tr><td>{i}</td></tr></table><video poster='p{i}'><source src='/v{i}'></video><meta name='k{i}' content='a'>" for i in range(n))
    html += "".join(f"<meta name='k{i}' content='b{i}'>" for i in range(n))
    df = el.with_elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    els, base = F.col("elements"), F.lit("http://s/")
    row = df.select(pg.tables(els).alias("t"), pg.videos(els, base).alias("v"), pg.meta(els, "basic").alias("m")).first()
    assert [t.rows for t in row.t] == [[[str(i)]] for i in range(n)]
    assert [v.sources[0].src for v in row.v] == [f"http://s/v{i}" for i in range(n)] and row.m == {f"k{i}": f"b{i}" for i in range(n)}


def test_nested_tables_and_boilerplate_rows(extract):
    html = "<nav><table><tr><td>n</table></nav><table><tr><td>a<table><tr><td>b</table></td></tr><nav><tr><td>c</tr></nav><tr><td>d</table>"
    assert [t.rows for t in extract(html).tables] == [[["ab", "b"], ["b"], ["d"]], [["b"]]]  # inner rows and cells are the outer's too
    whole = [t.rows for t in extract(html, drop_boilerplate=False).tables]
    assert whole[0] == [["n"]] and len(whole[1]) == 4 and whole[2] == [["b"]]
