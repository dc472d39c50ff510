"""Text features against short independent Python statements of the rules."""

import hashlib
import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pagemill import fixed_values as fixed
from pagemill.functions import text as tx
from pagemill.functions.common import round_to
from pagemill.operators import documents as docs

EDGES = [
    "", "   ", "don't stop", "...!!!", "a bb ccc dddd", "Été français. ÇA va? Oui!", "no terminator here", "x" * 9, "x" * 10,
    "tab\tand nbsp em. next", "One. Two. Three.", "One. Two. Three. Four.", "good good bad " * 3, "under_score 123 4567",
    "mail me@site.org and me@site.org, http://a.b/c?d=1 or 555-123-4567 on 1/2/2024 and 12-31-99.", "1.5 and 2.5!",
]


def words_of(text):
    return [w for w in re.sub(r"[^\w\s]", "", text.lower()).split() if len(w) > 2]


def sentences_of(text):
    return [s.strip() for s in re.split(r"[.!?]+", text) if s.strip()]


@pytest.fixture(scope="module")
def texts(spark, tiny):
    return EDGES + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()]


def test_tokens_and_sentences(one, texts):
    assert one(texts, lambda v: tx.tokens(F.col(v))) == [words_of(t) for t in texts]
    assert one(texts, lambda v: tx.sentences(F.col(v))) == [sentences_of(t) for t in texts]


def test_syllables(one, texts):
    assert one(texts, lambda v: tx.syllables(F.col(v))) == [max(1, len(re.findall("[aeiouy]+", t.lower()))) for t in texts]


def test_ranked_words_and_keywords(one, texts):
    ranked = one(texts, lambda v: tx.top_words(tx.ranked_words(tx.tokens(F.col(v)), 10)))
    assert [[tuple(w) for w in r] for r in ranked] == [Counter(words_of(t)).most_common(10) for t in texts]
    got = one(texts, lambda v: tx.keywords(tx.ranked_words(tx.tokens(F.col(v)), 20), F.size(tx.tokens(F.col(v)))))
    for text, row in zip(texts, got):
        n = len(words_of(text))
        want = [(w, c, round(c / n * math.log(n / c), 4)) for w, c in Counter(words_of(text)).most_common(20) if c > 1][:10]
        assert [tuple(k) for k in row] == want


def test_stats_round_like_python(one, texts):
    def build(v):
        return tx.basic_stats(tx.tokens(F.col(v)), F.size(tx.sentences(F.col(v))), tx.ranked_words(tx.tokens(F.col(v)), 10))

    for text, row in zip(texts, one(texts, build)):
        words, sents = words_of(text), sentences_of(text)
        if not words:
            assert row is None
            continue
        assert row.avg_word_length == round(sum(map(len, words)) / len(words), 2)
        assert row.avg_sentence_length == (round(len(words) / len(sents), 2) if sents else 0)
        assert row.vocabulary_diversity == round(len(set(words)) / len(words), 3)


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=50))
def test_round_to_is_python_round(one, values):
    for digits in (0, 1, 3):
        assert one(values, lambda v: round_to(F.col(v), digits), "double") == [round(x, digits) + 0.0 for x in values]


def test_rounding_ties(one):
    assert one([10.075, 0.0625, 2.675, 0.5, -0.0001], lambda v: round_to(F.col(v), 3), "double") == [10.075, 0.062, 2.675, 0.5, 0.0]
    assert one([10.075, 2.675], lambda v: round_to(F.col(v), 2), "double") == [10.07, 2.67]


def sentiment_of(positive, negative, total):
    return " ".join(["good"] * positive + ["bad"] * negative + ["word"] * (total - positive - negative))


def test_sentiment_bounds(one):
    cases = [sentiment_of(1, 0, 20), sentiment_of(2, 0, 20), sentiment_of(0, 1, 20), sentiment_of(0, 2, 20), "", sentiment_of(9, 1, 10)]
    rows = one(cases, lambda v: tx.sentiment(tx.tokens(F.col(v))))
    assert [r.label for r in rows] == ["neutral", "positive", "neutral", "negative", "neutral", "positive"]
    assert [r.score for r in rows] == [0.05, 0.1, -0.05, -0.1, 0.0, 0.8]
    assert rows[5].confidence == 1.0 and rows[0].confidence == 0.1


def test_topics_match_substrings_and_keep_lexicon_order(one):
    rows = one(["He said the market", "vote team", "nothing"], lambda v: tx.topics(F.lower(F.col(v))))
    assert [(t.topic, t.keyword_matches) for t in rows[0]] == [("business", 1), ("technology", 1)]
    assert [t.topic for t in rows[1]] == ["sports", "politics"]
    assert rows[2] == []
    assert rows[0][0].confidence == round(1 / 7, 3)


def test_content_type(one):
    rows = one(["news review", "how to learn, a guide", "plain"], lambda v: tx.content_type(F.lower(F.col(v))))
    assert [r.primary_type for r in rows] == ["news", "tutorial", "general"]
    assert rows[1].confidence == 1.0 and rows[1].all_scores == {"tutorial": 3}
    assert rows[2].confidence == 0.5 and rows[2].all_scores == {}


def test_language_only_sees_long_indicators(one):
    rows = one(["the and for", "que que the", "el la de", "the que"], lambda v: tx.language(tx.tokens(F.col(v))))
    assert [r.detected_language for r in rows] == ["english", "spanish", "unknown", "unknown"]
    assert rows[0].confidence == 1.0 and rows[2].confidence == 0.5


def test_summary(one, texts):
    rows = one(texts, lambda v: tx.summary(F.col(v), tx.sentences(F.col(v))))
    for text, row in zip(texts, rows):
        s = sentences_of(text)
        chosen = s if len(s) <= 3 else [s[0], s[len(s) // 2], s[-1]]
        want = " ".join(chosen)
        assert (row.summary, row.summary_length) == (want, len(want))
        assert row.compression_ratio == (round(len(want) / len(text), 3) if s else None)


def test_readability_bands(one):
    easy, hard = "The cat sat on the mat. The dog ran off.", "Incomprehensibility characteristically institutionalizes."
    rows = one([easy, hard, "..."], lambda v: tx.readability(F.size(tx.tokens(F.col(v))), F.size(tx.sentences(F.col(v))), tx.syllables(F.col(v))))
    assert rows[0].readability_level in [name for _, name in fixed.READABILITY_BANDS]
    assert rows[1].readability_level == "Very Difficult" and rows[1].flesch_reading_ease == 0.0
    assert rows[2] is None


def test_entities(one):
    row = one([EDGES[14]], lambda v: tx.entities(F.col(v)))[0]
    assert row.emails == ["me@site.org"]
    assert row.urls == ["http://a.b/c?d=1"]
    assert row.phone_numbers == ["555-123-4567"]
    assert row.dates == ["1/2/2024", "12-31-99"]


def test_storage_clean(one):
    assert one([" a  (b)\tc* d-e: f! ", None, "é #1"], lambda v: tx.clean_for_storage(F.col(v))) == ["a b c d-e: f!", "", "é 1"]


def test_fingerprint(one):
    def build(v):
        return tx.fingerprint("p", [F.col(v), F.lit(2)], F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("0")))

    assert one(["x"], build) == [hashlib.md5(b"p:x:2:a:0:b:1").hexdigest()]


def test_full_analysis_gates_short_texts(spark):
    df = spark.createDataFrame([(1, "short"), (2, "A longer good text here."), (3, "A longer good text here."), (4, "short")], "id long, text string")
    rows = {r.id: r for r in docs.full_analysis(df, "id").collect()}
    assert rows[1].basic_stats is None and rows[1].content_type.primary_type == "unknown"
    assert rows[1].language_detection.detected_language == "unknown" and rows[1].topics == []
    assert not rows[4].duplicate_score.is_duplicate  # short texts are never remembered
    assert not rows[2].duplicate_score.is_duplicate
    assert rows[3].duplicate_score.is_duplicate and rows[3].duplicate_score.first_seen == 2


def test_clean_record_counts_before_caps(spark):
    heads = ["abc", "abcd"] + [f"heading {i}" for i in range(12)]
    paras = ["x" * 20, "x" * 21] + ["y" * 30] * 25
    df = spark.createDataFrame([("1", "u", "a title", heads, paras)], "id string, url string, title string, headings array<string>, paragraphs array<string>")
    whole = docs.clean_record(df).first()
    assert (len(whole.headings), len(whole.paragraphs)) == (13, 26)
    row = docs.clean_record(df, max_headings=10, max_paragraphs=20).first()
    assert (row.headings_count, len(row.headings)) == (13, 10)
    assert (row.paragraphs_count, len(row.paragraphs)) == (26, 20)
    assert row.content_length == 0


def test_analysis_is_map_only(spark, tiny):
    plan = docs.analyse(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
