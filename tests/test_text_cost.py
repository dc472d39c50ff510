"""What the analysis of a text costs: each term searched once, words counted without sorting them all."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagemill import fixed_values as fixed
from pagemill.functions import text as tx
from pagemill.operators import corpus


def plan_of(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_terms_are_searched_once(spark):
    plan = plan_of(spark.range(3).select(tx.topics(F.lower(F.concat(F.col("id").cast("string"), F.lit("market"))))), "optimizedPlan")
    assert plan.count("Contains(") == sum(map(len, fixed.TOPIC_KEYWORDS.values()))


@pytest.mark.parametrize("limit", [1, 3, 20, 2**31 - 1])
def test_ranks_of_repeated_and_single_words(one, limit):
    draw = random.Random(5)
    texts = [[draw.choice(["aaa", "bbb", "ccc", "é1x", "ddd", "eee", "zzz", "😀ab"]) for _ in range(n)] for n in range(14)]
    texts += [[], ["one"], ["one", "one"], ["two", "one", "two", "one", "six"], [f"w{i % 700}" for i in range(3000)]]
    got = one(texts, lambda v: tx.ranked_words(F.col(v), limit), "array<string>")
    assert [[(r.word, -r.neg_count) for r in row] for row in got] == [Counter(t).most_common(limit) for t in texts]
    for row in got:
        places = [(r.neg_count, r.first_pos) for r in row]
        assert places == sorted(set(places))
    assert one([None], lambda v: tx.ranked_words(F.col(v), limit), "array<string>") == [[]]


def test_entities_are_those_of_the_plain_patterns(one):
    texts = ["", "a@b.co, a@b.co x@y.zz", "no sign", "555-123-4567 x5551234567 ٣٤٥٣٤٥٣٤٥٣ 1/2/2020 a1/2/2020", "@", "http://x/y?z 12-12-12"]
    rows = one([*texts, None], lambda v: tx.entities(F.col(v)))
    for text, row in zip(texts, rows):
        for kind, pattern in fixed.ENTITY_PATTERNS.items():
            assert row[kind] == sorted({m.group() for m in re.finditer(pattern, text)}), (kind, text)
    assert rows[-1].emails is None and rows[-1].dates is None


@pytest.mark.parametrize("kind", ["long", "string"])
def test_words_of_a_crawl_are_counted_without_a_sort(spark, kind):
    def order(at):
        return at if at is None or kind == "long" else f"p{at + 5:05d}"

    pages = [("a", 7, ["xxx", "yyy", "xxx"]), ("a", -3, ["yyy", "zzz"]), ("a", 7, ["zzz", "new"]), ("a", None, ["www"]), ("a", 2**40, ["late", "www"]), ("b", 0, []), (None, 1, ["xxx"])]
    df = spark.createDataFrame([(k, order(at), w) for k, at, w in pages], f"crawl string, page {kind}, _words array<string>")
    counted = corpus.crawl_words(df, "crawl", "page")
    assert kind == "string" or "SortAggregate" not in plan_of(counted)
    rows = counted.filter("crawl = 'a'").orderBy("first_at").collect()
    assert [(r.word, r["count"]) for r in rows] == [("www", 2), ("yyy", 2), ("zzz", 2), ("xxx", 2), ("new", 1), ("late", 1)]
    assert counted.filter("crawl IS NULL").count() == 1 and counted.filter("crawl = 'b'").count() == 0
