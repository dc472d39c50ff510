"""Insights across the pages of a crawl or a corpus.

A combined analysis is the analysis of all page texts joined by spaces. The texts
are never joined: every figure is put together from per-page parts (sums, bit sets,
word counts, and the sentence pieces at page borders), so a crawl may have any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from pagemill import fixed_values as fixed
from pagemill.functions import text as tx
from pagemill.functions.common import SPACE_CHARS, round_to, strip, unnest
from pagemill.plans.ordered import join_null_safe, running_totals
from pagemill.plans.skew import join_on_hot_key
from pagemill.plans.stored import materialize

TOPIC_TERMS = [(topic, word) for topic, words in fixed.TOPIC_KEYWORDS.items() for word in words]
TYPE_TERMS = [(kind, word) for kind, words in fixed.TYPE_INDICATORS.items() for word in words]
BROADCAST_ROWS = 50_000  # narrow rows of a side that is broadcast after it was counted
BORDER = max(len(word) for _, word in TOPIC_TERMS + TYPE_TERMS) - 1  # characters a term can reach past a page border


def page_texts(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, text) of page records whose headings are plain texts."""
    return pages.select(*keys, tx.page_text(F.col("title"), F.col("headings"), F.col("paragraphs")).alias("text"))


def dominant_topics(analysed: DataFrame, order: str, keys: Sequence[str] = (), limit: int = 5) -> DataFrame:
    """Topics by number of pages, with their total confidence; ties by first appearance."""
    rows = unnest(analysed, [*keys, order], "topics", "_topic", "_rank")
    counted = rows.groupBy(*keys, F.col("_topic.topic").alias("topic")).agg(
        F.count("*").alias("pages"),
        F.sum("_topic.confidence").alias("total_confidence"),
        # Two columns of fixed width, where a struct would make Spark sort all rows to aggregate them.
        F.min(order).alias("_seen"), F.min_by("_rank", order).alias("_seen_rank"),
    )
    by = [F.desc("pages"), F.asc("_seen"), F.asc("_seen_rank")]
    if not keys:
        return counted.orderBy(*by).limit(limit).drop("_seen", "_seen_rank")
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
    return ranked.filter(F.col("rank") <= limit).drop("_seen", "_seen_rank")


def average_sentiment(analysed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean sentiment score and number of pages; short pages count as 0."""
    return analysed.groupBy(*keys).agg(
        round_to(F.coalesce(F.avg("sentiment.score"), F.lit(0.0)), 3).alias("average_sentiment"),
        F.count("*").alias("total_pages_analyzed"),
    )


def content_type_distribution(analysed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    counted = analysed.groupBy(*keys, F.col("content_type.primary_type").alias("content_type")).agg(
        F.count("*").alias("pages")
    )
    return counted.orderBy(*keys, F.desc("pages"), "content_type")


def _bits(lower_text: Column, terms: list[tuple[str, str]]) -> Column:
    """One bit per term found in the text."""
    if len(terms) > 63:
        raise ValueError("a bit mask holds 63 terms")
    mask = F.lit(0).cast("long")
    for place, (_, word) in enumerate(terms):
        mask = mask.bitwiseOR(F.when(F.contains(lower_text, F.lit(word)), F.lit(1 << place).cast("long")).otherwise(0))
    return mask


def _group_hits(mask: Column, terms: list[tuple[str, str]]) -> dict[str, Column]:
    groups: dict[str, int] = {}
    for place, (group, _) in enumerate(terms):
        groups[group] = groups.get(group, 0) | (1 << place)
    return {group: F.bit_count(mask.bitwiseAND(F.lit(bits).cast("long"))).cast("int") for group, bits in groups.items()}


def crawl_words(pages: DataFrame, key: str, order: str) -> DataFrame:
    """Word counts per crawl with the place of the first occurrence.

    ``pages`` holds the words of each page in order (``_words``). They are counted map-side, so distinct words per task are shuffled.
    """
    place = F.col(order)
    if isinstance(pages.schema[order].dataType, IntegralType):
        # Page and position as one number of fixed width, where a struct would make Spark sort all words to aggregate them.
        whole = F.coalesce(place.cast("decimal(20,0)"), F.lit(Decimal(-(2**63) - 1)))
        pages = pages.select(key, "_words", (whole * F.lit(Decimal(2**31))).alias("_page"))
        rows, first = unnest(pages, [key, "_page"], "_words", "_w"), F.col("_page") + F.col("pos")
    else:
        rows = unnest(pages, [key, order], "_words", "_w")
        first = F.struct(place, F.col("pos").alias("first_pos"))
    return rows.groupBy(key, F.col("_w").alias("word")).agg(F.count("*").alias("count"), F.min(first).alias("first_at"))


def combined_words(words: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Per crawl: number of distinct words and the ranked top words."""
    by = Window.partitionBy(key).orderBy(F.desc("count"), F.asc("first_at"))
    top = words.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= limit)
    ranked = top.groupBy(key).agg(
        F.sort_array(
            F.collect_list(
                F.struct((-F.col("count")).cast("int").alias("neg_count"), F.col("_rank").alias("first_pos"), F.col("word"))
            )
        ).alias("ranked")
    )
    return join_null_safe(words.groupBy(key).agg(F.count("*").alias("unique_words")), ranked, [key])


def _pieces(text: Column) -> Column:
    """Stretches between terminators; the joining space belongs to the page before it."""
    return F.split(F.concat(text, F.lit(" ")), "[.!?]+")


def _inner(pieces: Column) -> Column:
    """Sentences wholly inside a page: the non-blank pieces between its first and last."""
    middle = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.filter(F.transform(middle, strip), lambda piece: piece != "")


LEXICONS = {
    "positive": fixed.POSITIVE_WORDS, "negative": fixed.NEGATIVE_WORDS, "english": fixed.ENGLISH_WORDS, "spanish": fixed.SPANISH_WORDS,
}
SUMS = ["n", "letters", "vowels", "positive", "negative", "english", "spanish", "chars", "trimmed"]


def page_features(texts: DataFrame, key: str, order: str) -> DataFrame:
    """Everything a crawl's analysis needs of a page, from one reading of its text; stored. ``_words`` are the page's words in order."""
    base = texts.select(
        key, order, "text", tx.tokens(F.col("text")).alias("_words"), _pieces(F.col("text")).alias("_p"),
        F.lower("text").alias("_low"),
    )
    words, listed = F.col("_words"), tx.counts_in(F.col("_words"), LEXICONS)
    counted = base.withColumn("_listed", listed).select(
        key,
        order,
        F.size(words).alias("n"),
        F.aggregate(words, F.lit(0), lambda total, word: total + F.length(word)).alias("letters"),
        tx.vowel_runs(F.col("text")).alias("vowels"),
        *[F.col(f"_listed.{name}").alias(name) for name in LEXICONS],
        (F.length("text") + 1).alias("chars"),
        F.length(strip(F.col("text"))).alias("trimmed"),
        _bits(F.col("_low"), TOPIC_TERMS).alias("topic_bits"),
        _bits(F.col("_low"), TYPE_TERMS).alias("type_bits"),
        F.right("_low", F.lit(BORDER)).alias("_end"),
        F.substring("_low", 1, BORDER).alias("_start"),
        (F.size("_p") - 1).alias("_marks"),
        F.size(_inner(F.col("_p"))).alias("_n_inner"),
        (strip(F.get("_p", F.lit(0))) != "").alias("_head_filled"),
        (strip(F.element_at("_p", -1)) != "").alias("_tail_filled"),
        words,
    )
    return materialize(counted, "page-features")


def page_parts(features: DataFrame, key: str, order: str) -> DataFrame:
    """The features without words: one narrow row per page, numbered within its crawl.

    ``_page`` is the page's index in the crawl. Segments are the stretches between
    terminators over the whole crawl; the last piece of a page and the first of the next
    share one, and ``_head_id`` and ``_tail_id`` number the page's first and last.
    """
    numbered = running_totals(features.drop("_words"), [F.col(order).asc()], {"_marks": "_tail_id"}, [key], index="_page")
    return materialize(numbered.withColumn("_head_id", F.col("_tail_id") - F.col("_marks")), "page-parts")


def combined_sentences(texts: DataFrame, parts: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(sentences per crawl, pieces of the summary).

    The summary is made of the first, middle and last sentence. A sentence may run over any number of pages without a terminator, so it is kept
    as pieces: (``key``, ``sentence``, ``order``, ``text``), one row per page that it touches, trimmed at both ends of the sentence and
    without empty ones. Joined in that order, with a space between two sentences, they are the summary.
    """
    parts = parts.select(key, order, "_page", "_marks", "_head_id", "_tail_id", "_n_inner", "_head_filled", "_tail_filled")
    has_tail = F.col("_marks") > 0
    head = F.struct(F.col("_head_id").alias("id"), F.col("_head_filled").alias("filled"), F.lit(0).alias("piece"))
    tail = F.struct(F.col("_tail_id").alias("id"), F.col("_tail_filled").alias("filled"), F.lit(-1).alias("piece"))
    ends = F.when(has_tail, F.array(head, tail)).otherwise(F.array(head))
    borders = parts.select(key, order, F.inline(ends))
    filled = borders.groupBy(key, "id").agg(F.max("filled").cast("int").alias("_filled"))
    # A page owns its inner sentences and, with a terminator, its tail; the first page also
    # owns its head. Both joins meet one row per key on either side, whatever the crawl's size.
    tails = join_null_safe(parts.filter(has_tail), filled.withColumnRenamed("id", "_tail_id"), [key, "_tail_id"])
    heads = join_null_safe(parts.filter("_page = 0"), filled.withColumnRenamed("id", "_head_id"), [key, "_head_id"])
    rows = parts.select(key, order, "_head_id", "_tail_id", "_n_inner")
    rows = rows.unionByName(tails.select(key, order, F.col("_filled").alias("_closes")), allowMissingColumns=True)
    rows = rows.unionByName(heads.select(key, order, F.col("_filled").alias("_leads")), allowMissingColumns=True)
    ends_of = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("_leads", "_closes")]
    own = rows.groupBy(key, order).agg(*[F.max(c).alias(c) for c in ("_head_id", "_tail_id", "_n_inner")], *ends_of)
    own = own.withColumn("_own", F.col("_leads") + F.col("_n_inner") + F.col("_closes"))
    placed = running_totals(own, [F.col(order).asc()], {"_own": "_upto"}, [key])
    totals = placed.groupBy(key).agg(F.max("_upto").alias("sentences"), F.count("*").alias("_pages"))
    last = F.col("sentences").cast("int") - 1
    wanted = F.when(F.col("sentences") <= 3, F.sequence(F.lit(0), last)).otherwise(
        F.array(F.lit(0), (F.col("sentences") / 2).cast("int"), last)
    )
    targets = totals.filter("sentences > 0").select(key, "_pages", wanted.alias("_targets"))
    near = join_on_hot_key(placed, targets, key, "_pages", order)
    inside_page = lambda at: (at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_own"))
    holders = unnest(near, ["*"], F.filter("_targets", inside_page), "_at", "_nth")
    local = (F.col("_at") - (F.col("_upto") - F.col("_own")) - F.col("_leads")).cast("int")
    is_inner = (local >= 0) & (local < F.col("_n_inner"))
    border_id = F.when(local < 0, F.col("_head_id")).otherwise(F.col("_tail_id"))
    found = holders.select(key, order, "_at", F.when(is_inner, local).alias("_local"), border_id.alias("id"))
    # Fetch the few sentences from the texts; one across pages is joined from its pieces.
    inside = found.filter("_local IS NOT NULL").select(key, order, "_at", "_local", F.lit(None).cast("int").alias("piece"))
    # A sentence may span any number of pages without a terminator; all of it is one value.
    across = join_null_safe(found.filter("_local IS NULL").select(key, "id", "_at"), borders, [key, "id"])
    across = across.select(key, order, "_at", F.lit(None).cast("int").alias("_local"), "piece")
    pieces = _pieces(F.col("text"))
    chosen = F.when(F.col("_local").isNotNull(), F.get(_inner(pieces), F.col("_local"))).otherwise(
        F.when(F.col("piece") == 0, F.get(pieces, F.lit(0))).otherwise(F.element_at(pieces, -1))
    )
    wanted = materialize(inside.unionByName(across), "wanted")
    # A few sentences per crawl, unless one runs over very many pages: only a counted, small side is broadcast.
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    fetched = join_null_safe(texts.select(key, order, "text"), wanted, [key, order])
    raw = materialize(fetched.select(key, F.col("_at").alias("sentence"), order, chosen.alias("text")), "sentence-pieces")
    whole = F.struct(key, "sentence").alias("_whole")
    filled = raw.filter(strip(F.col("text")) != "").groupBy(whole).agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
    sizes = raw.groupBy(whole).agg(F.count("*").alias("_rows"))
    edges = sizes.join(filled, "_whole", "left")
    near = join_on_hot_key(raw.withColumn("_whole", whole), edges, "_whole", "_rows", order)
    text, spaces = F.col("text"), F.lit(SPACE_CHARS)
    text = F.when(F.col(order) == F.col("_first"), F.ltrim(text, spaces)).otherwise(text)
    text = F.when(F.col(order) == F.col("_last"), F.rtrim(text, spaces)).otherwise(text)
    pieces = near.filter(F.col(order).between(F.col("_first"), F.col("_last"))).select(key, "sentence", order, text.alias("text")).filter("text <> ''")
    return totals.select(key, "sentences"), materialize(pieces, "summary-pieces")


def summaries(pieces: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """Per crawl ``summary_length`` and ``summary``; with ``limit`` a summary of more characters stays pieces, on the caller's request."""
    lengths = pieces.groupBy(key, "sentence").agg(F.sum(F.length("text")).alias("_n"))
    lengths = lengths.groupBy(key).agg((F.sum("_n") + F.count("*") - 1).alias("summary_length"))
    if limit is not None:
        pieces = join_null_safe(pieces, lengths.filter(F.col("summary_length") <= limit).select(key), [key])
    sentences = pieces.groupBy(key, "sentence").agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("_t"))
    joined = F.array_join(F.transform("_t", lambda t: t["text"]), "").alias("_s")
    texts = sentences.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sentence", joined))).alias("_all"))
    summary = F.array_join(F.transform("_all", lambda s: s["_s"]), " ")
    # A summary may be far longer than Spark's estimate of it, so its row is never broadcast.
    return join_null_safe(lengths, texts.hint("merge"), [key], "left").select(key, "summary_length", summary.alias("summary"))


def combined_analysis(texts: DataFrame, key: str, order: str, summary_limit: int | None = None, pieces: bool = False):
    """One analysis row per crawl over (key, order, text) rows made by :func:`page_texts`.

    Summaries are whole, whatever their length. A caller that sets ``summary_limit`` gets null for one of more characters (a sentence over very
    many pages), but its length; with ``pieces`` the result is (analysis, pieces of all summaries as :func:`combined_sentences` has them).
    """
    features = page_features(texts, key, order)
    parts = page_parts(features, key, order)
    sums = parts.groupBy(key).agg(
        F.count("*").alias("pages"),
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.bit_or(c).alias(c) for c in ("topic_bits", "type_bits")],
    )
    words = materialize(crawl_words(features, key, order), "words")
    sentences, found = combined_sentences(texts, parts, key, order)
    joined = sums
    for part in (combined_words(words, key), sentences, summaries(found, key, order, summary_limit).hint("merge"), _border_bits(parts, key)):
        joined = join_null_safe(joined, part, [key], "left")
    for bits in ("topic_bits", "type_bits"):
        joined = joined.withColumn(bits, F.col(bits).bitwiseOR(F.coalesce(F.col(f"_border_{bits}"), F.lit(0).cast("long"))))
    analysis = _compose(joined, key)
    return (analysis, found) if pieces else analysis


def _border_bits(parts: DataFrame, key: str) -> DataFrame:
    """Terms of several words that straddle the space between two pages.

    A page text holds two spaces of its own, more than any term, so a term reaches
    over one border at most and the texts next to it suffice.
    """
    before = parts.select(key, (F.col("_page") + 1).alias("_page"), "_end")
    pairs = join_null_safe(parts.select(key, "_page", "_start"), before, [key, "_page"])
    pairs = pairs.select(key, F.concat("_end", F.lit(" "), "_start").alias("_border"))
    return pairs.groupBy(key).agg(
        F.bit_or(_bits(F.col("_border"), TOPIC_TERMS)).alias("_border_topic_bits"),
        F.bit_or(_bits(F.col("_border"), TYPE_TERMS)).alias("_border_type_bits"),
    )


def _compose(joined: DataFrame, key: str) -> DataFrame:
    """Put the analysis together from a crawl's totals."""
    n, m = F.nullif("n", F.lit(0)), F.nullif("sentences", F.lit(0))
    ranked = F.coalesce("ranked", F.array().cast(tx.RANKED_TYPE))
    short = F.col("trimmed") < 10
    syllables = F.greatest(F.lit(1), F.col("vowels"))
    length = F.coalesce("summary_length", F.lit(0)).cast("long")
    summary = F.when(length == 0, "").otherwise(F.col("summary"))
    no_hits = {name: F.lit(0) for name in [*fixed.TOPIC_KEYWORDS, *fixed.TYPE_INDICATORS]}
    stats = F.struct(
        F.col("n").alias("total_words"), F.col("unique_words"), round_to(F.col("letters") / n, 2).alias("avg_word_length"),
        F.coalesce(round_to(n / m, 2), F.lit(0.0)).alias("avg_sentence_length"),
        tx.top_words(ranked).alias("most_common_words"), round_to(F.col("unique_words") / n, 3).alias("vocabulary_diversity"),
    )
    kind = tx.content_type_from_hits(_group_hits(F.col("type_bits"), TYPE_TERMS))
    speech = tx.language_from_counts(F.col("english"), F.col("spanish"), n)
    return joined.select(
        key,
        "pages",
        F.when(~short & n.isNotNull(), stats).alias("basic_stats"),
        F.when(~short, tx.readability(F.col("n"), F.col("sentences"), syllables)).alias("readability"),
        F.when(short, tx.sentiment_from_counts(F.lit(0), F.lit(0), F.lit(0)))
        .otherwise(tx.sentiment_from_counts(F.col("positive"), F.col("negative"), n)).alias("sentiment"),
        F.when(short, tx.topics_from_hits(no_hits))
        .otherwise(tx.topics_from_hits(_group_hits(F.col("topic_bits"), TOPIC_TERMS))).alias("topics"),
        F.when(short, tx.keywords(F.slice(ranked, 1, 0), n)).otherwise(tx.keywords(ranked, n)).alias("keywords"),
        F.struct(
            F.when(short, "unknown").otherwise(kind["primary_type"]).alias("primary_type"),
            F.when(short, 0.0).otherwise(kind["confidence"]).alias("confidence"),
        ).alias("content_type"),
        F.struct(
            F.when(short, "unknown").otherwise(speech["detected_language"]).alias("detected_language"),
            F.when(short, 0.0).otherwise(speech["confidence"]).alias("confidence"),
        ).alias("language_detection"),
        F.struct(
            F.when(short, "").otherwise(summary).alias("summary"),
            F.when(short, 0).otherwise(length).alias("summary_length"),
            F.when(~short & m.isNotNull(), round_to(length / F.col("chars"), 3)).alias("compression_ratio"),
        ).alias("summary"),
        F.when(~short, F.col("chars")).alias("text_length"),
        F.when(~short, F.col("n")).alias("word_count"),
        F.when(~short, F.col("sentences")).alias("sentence_count"),
    )


def combined_entities(texts: DataFrame, key: str) -> DataFrame:
    """Distinct entities per crawl, one row each; no pattern reaches over a space."""
    found = texts.select(key, tx.entities(F.col("text")).alias("_e"))
    kinds = [F.struct(F.lit(kind).alias("kind"), F.col(f"_e.{kind}").alias("values")) for kind in fixed.ENTITY_PATTERNS]
    rows = unnest(found, [key], F.array(*kinds), "_k").select(key, "_k.kind", "_k.values")
    return unnest(rows, [key, "kind"], "values", "value").select(key, "kind", "value").distinct()
