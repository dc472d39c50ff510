"""The combined analysis of a crawl equals the analysis of its joined text."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import corpus, documents as docs, recommend as rec

CRAWLS = {
    "one": ["Only page. It has two sentences here"],
    "open": ["no end  at all", "still  going", "and  on. Now done!", "  ", "tail  of it"],
    "border": ["about  machine", "learning things are  good how", "to do it step. by", "step  guide. Good great awful"],
    "short": ["  a", "b  "],
    "dots": ["...  !!", "?  ", "Last one  here"],
    "many": [f"Page {i}  talks about cloud database number {i % 7}. It is good! Is it {i}?" for i in range(40)],
}
TEXT_COLUMNS = ["basic_stats", "readability", "sentiment", "topics", "keywords", "language_detection", "summary"]


@pytest.fixture(scope="module")
def pair(spark):
    rows = [(k, i, t) for k, texts in CRAWLS.items() for i, t in enumerate(texts)]
    texts = spark.createDataFrame(rows, "crawl string, page long, text string").repartition(5)
    combined = {r.crawl: r for r in corpus.combined_analysis(texts, "crawl", "page").collect()}
    joined = [(k, "".join(t + " " for t in texts)) for k, texts in CRAWLS.items()]
    whole = docs.analyse(spark.createDataFrame(joined, "crawl string, text string"))
    return combined, {r.crawl: r for r in whole.collect()}


@pytest.mark.parametrize("crawl", list(CRAWLS))
def test_combined_equals_joined(pair, crawl):
    got, want = pair[0][crawl], pair[1][crawl]
    for column in TEXT_COLUMNS:
        assert got[column] == want[column], column
    assert got.content_type.primary_type == want.content_type.primary_type
    assert got.content_type.confidence == want.content_type.confidence
    assert (got.text_length, got.word_count, got.sentence_count) == (
        want.metadata.text_length, want.metadata.word_count, want.metadata.sentence_count)


def test_summaries_as_pieces(spark):
    """A sentence over many pages stays in pieces beyond the limit; its pieces and its length are those of the whole."""
    rows = [("long", i, f" word{i}  " if i % 3 else "  ") for i in range(400)] + [("two", 0, " One.  And "), ("two", 1, " two "), ("two", 2, "  ")]
    texts = spark.createDataFrame(rows, "crawl string, page long, text string").repartition(5)
    whole = {r.crawl: r.summary for r in corpus.combined_analysis(texts, "crawl", "page").collect()}
    analysis, pieces = corpus.combined_analysis(texts, "crawl", "page", summary_limit=50, pieces=True)
    cut = {r.crawl: r.summary for r in analysis.collect()}
    assert cut["long"].summary is None and cut["two"] == whole["two"] and cut["two"].summary.startswith("One And")
    assert cut["long"].summary_length == whole["long"].summary_length == len(whole["long"].summary) > 2000
    assert cut["long"].compression_ratio == whole["long"].compression_ratio
    rows = pieces.filter("crawl = 'long'").orderBy("sentence", "page").collect()
    assert "".join(r.text for r in rows) == whole["long"].summary and len(rows) > 300


def test_summaries_of_any_length_are_whole(spark):
    """One sentence over 17 pages of a million characters: its summary is as long, in its row."""
    page = F.concat(F.lit("  "), F.repeat(F.concat(F.lit("w"), F.col("id"), F.lit(" ")), 1_000_000 // 3))
    texts = spark.range(17).select(F.lit("long").alias("crawl"), F.col("id").alias("page"), page.alias("text"))
    want = "".join(r.text + " " for r in texts.orderBy("page").collect()).strip()
    row = corpus.combined_analysis(texts, "crawl", "page").select("summary.*").first()
    assert len(want) > 16_000_000 and row.summary == want and row.summary_length == len(want)


def test_border_terms_are_found(pair):
    topics = {t.topic for t in pair[0]["border"].topics}
    assert {"technology", "education"} <= topics and pair[0]["border"].content_type.primary_type == "tutorial"


def test_insights(spark):
    texts = ["market revenue talk here", "market and team here", "good news", "short", "team market vote today"]
    df = docs.analyse(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    rows = corpus.dominant_topics(df, "id").collect()
    assert [(r.topic, r.pages) for r in rows] == [("business", 3), ("sports", 2), ("politics", 1)]
    assert corpus.average_sentiment(df).first()[:] == (0.0, 5)  # texts under ten characters count as 0
    assert {r.content_type: r.pages for r in corpus.content_type_distribution(df).collect()}["unknown"] == 2


@pytest.fixture
def score(spark):
    def run(url, text, terms, kind="general"):
        df = spark.createDataFrame([(url, text, terms, kind)], "u string, t string, k array<string>, c string")
        row = df.select(rec.relevance(*[F.col(c) for c in "utkc"]).alias("s"), rec.reasoning(F.col("t"), F.col("k"), F.col("c")).alias("r")).first()
        return row.s, row.r

    return run


def test_relevance_keeps_the_order_of_additions(score):
    # two routes to one tenth: only one stays above it in floating point
    assert score("http://alpha", "learn click free", ["alpha"])[0] > 0.1
    assert not score("http://x", "alpha click free", ["alpha"])[0] > 0.1
    assert score("http://x", "read more here download free click", [])[0] == 0.0
    assert score("http://a", "a b c d e", list("abcde"))[0] == 1.0
    assert score("http://x/docs", "manual", [], "technical")[0] == pytest.approx(0.3)


def test_reasoning(score):
    assert score("u", "zeta beta alpha gamma", ["zeta", "alpha", "gamma", "beta"])[1] == "Contains key topics: alpha, beta, gamma"
    assert score("u", "alpha guide", ["alpha"], "tutorial")[1] == "Contains key topics: alpha; Provides learning resources"
    assert score("u", "blog", [], "news")[1] == "Related news/articles"
    assert score("u", "blog course", [], "review")[1] == "Educational content"
    assert score("u", "x", [])[1] == "Contextually related to current topic"


def test_first_link_consumes_its_domain(spark):
    rows = [(1, 1, "http://a/1", "nothing"), (1, 2, "http://a/2", "Alpha"), (1, 3, "", "Alpha"), (1, 4, "http://b/1", ""), (1, 5, "http://b/2", "ALPHA guide"), (1, 6, "http://c", "alpha")]
    links = spark.createDataFrame(rows, "crawl long, at long, url string, text string")
    analysis = spark.createDataFrame(
        [(1, [("technology", 0.5, 4)], [("alpha", 3, 0.1)], ("general", 0.5))],
        "crawl long, topics array<struct<topic:string,confidence:double,keyword_matches:long>>, keywords array<struct<word:string,frequency:long,importance:double>>, content_type struct<primary_type:string,confidence:double>")
    top = rec.top_recommendations(rec.scored_links(links, analysis, "crawl", "at"), "crawl", "at").orderBy("rank").collect()
    assert [(r.url, r.relevance_score) for r in top] == [("http://b/2", 0.4), ("http://c", 0.3)]
    assert rec.link_totals(links, "crawl").first()[:] == (1, 6, 3)


def test_paths_and_suggestions(spark):
    schema = "id long, topics array<struct<topic:string>>, keywords array<struct<word:string,frequency:long>>, kind string"
    df = spark.createDataFrame([
        (1, [("technology",)], [("ab", 2), ("cd", 3)], "technical"), (2, [("sports",)], [("ab", 2)], "news"), (3, [], [("ab", 9)], "news"), (4, [("health",)], [], "news"),
    ], schema)
    steps = {(r.id, r.step_no): r.step for r in rec.learning_path(df, "id").collect()}
    assert steps[1, 1] == "Fundamentals" and steps[2, 4] == "Practical Application" and steps[4, 2] == "Research & Studies"
    assert len(steps) == 12
    got = [r[0] for r in df.orderBy("id").select(rec.search_suggestions(F.col("topics"), F.col("keywords"), F.col("kind"))).collect()]
    assert got[0] == ["technology cd tutorial", "technology cd guide", "best technology cd resources", "technology cd examples", "learn technology cd",
                      "technology documentation", "technology API reference", "technology best practices"]
    assert got[1:] == [["sports latest news", "sports updates", "sports trends"], [], []]
    focus = [r[0].focus for r in df.orderBy("id").select(rec.strategy(F.col("topics"), F.col("kind"))).collect()]
    assert focus[0] == "Finding content related to technology" and focus[2] == "General content discovery based on keywords"
