"""Per-document analysis and duplicate marking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill import fixed_values as fixed
from pagemill.functions import text as tx
from pagemill.plans.skew import join_on_hot_key
from pagemill.plans.stored import materialize


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens`` and ``sentences``, which most features share."""
    return df.withColumn("tokens", tx.tokens(F.col(text))).withColumn("sentences", tx.sentences(F.col(text)))


def analyse(df: DataFrame, text: str = "text", as_of: Column | None = None) -> DataFrame:
    """Add every analysis as a struct column; short texts get the fixed empty analysis.

    Map-only: one pass over the text, no shuffle. ``duplicate_score`` needs the whole
    corpus and comes from :func:`mark_duplicates`.
    """
    body = F.col(text)
    base = with_tokens(df, text).withColumn("_ranked", tx.ranked_words(F.col("tokens"), 20))
    base = base.withColumn("_lower", F.lower(body)).withColumn("_short", tx.too_short(body))
    words, pieces, ranked, short = F.col("tokens"), F.col("sentences"), F.col("_ranked"), F.col("_short")
    n, m = F.size(words), F.size(pieces)
    no_counts = {name: F.lit(0) for name in [*fixed.TOPIC_KEYWORDS, *fixed.TYPE_INDICATORS]}
    type_type = "struct<primary_type:string,confidence:double,all_scores:map<string,bigint>>"
    unknown_type = F.struct(F.lit("unknown"), F.lit(0.0), F.create_map().cast("map<string,bigint>")).cast(type_type)
    unknown_language = F.struct(F.lit("unknown").alias("detected_language"), F.lit(0.0).alias("confidence"))
    no_sentiment = tx.sentiment_from_counts(F.lit(0), F.lit(0), F.lit(0))
    no_summary = tx.summary(F.lit(""), F.array().cast("array<string>"))

    def gated(full: Column, otherwise: Column) -> Column:
        return F.when(short, otherwise).otherwise(full)

    no_entities = F.array().cast("array<string>")
    found_entities = [gated(values, no_entities).alias(kind) for kind, values in tx.entities_by_kind(body).items()]
    columns = {
        "basic_stats": F.when(~short, tx.basic_stats(words, m, ranked)),
        "readability": F.when(~short, tx.readability(n, m, tx.syllables(body))),
        "sentiment": gated(tx.sentiment(words), no_sentiment),
        "topics": gated(tx.topics(F.col("_lower")), tx.topics_from_hits(no_counts)),
        "keywords": gated(tx.keywords(ranked, n), tx.keywords(F.slice(ranked, 1, 0), n)),
        "content_type": gated(tx.content_type(F.col("_lower")).cast(type_type), unknown_type),
        "language_detection": gated(tx.language(words), unknown_language),
        "summary": gated(tx.summary(body, pieces), no_summary),
        "entities": F.struct(*found_entities),  # gated by kind, so that kinds nobody asks for are not searched
        "metadata": F.struct(
            (as_of if as_of is not None else F.current_timestamp()).alias("analyzed_at"),
            F.when(~short, F.length(body)).cast("long").alias("text_length"),
            F.when(~short, n).cast("long").alias("word_count"),
            F.when(~short, m).cast("long").alias("sentence_count"),
        ),
    }
    return base.withColumns(columns).drop("_ranked", "_lower", "_short")


BROADCAST_ROWS = 50_000  # narrow rows of a side that is broadcast after it was counted


def hashed_texts(df: DataFrame, key: str, text: str = "text", first_seen: str | None = None) -> DataFrame:
    """Stored rows (``key``, ``text_hash``, ``_seen``): the text is read and hashed once, and goes no further."""
    at = F.col(first_seen) if first_seen else F.col(key)
    return materialize(df.select(F.col(key), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), at.alias("_seen")), "hashes")


def mark_hashed(hashed: DataFrame, key: str, seen: DataFrame | None = None) -> DataFrame:
    """Flags for the rows of ``hashed_texts``. A hash shared by a third of the corpus is counted map-side and joined back over salted tasks.

    ``seen`` (text_hash, first_key, first_seen) holds texts known from before.
    """
    firsts = hashed.groupBy("text_hash").agg(
        # Fixed-width minima where the columns allow, so that Spark aggregates by hash and sorts nothing.
        F.min(key).alias("_key"), F.min_by("_seen", key).alias("_at"), F.count("*").alias("copies"),
    ).select("text_hash", F.struct(F.col("_key").alias("first_key"), F.col("_at").alias("first_seen")).alias("_first"), "copies")
    known = F.lit(False)
    if seen is not None:
        before = seen.select("text_hash", F.struct("first_key", "first_seen").alias("_before"))
        firsts = firsts.join(before, "text_hash", "left").withColumn("_first", F.coalesce("_before", "_first"))
        known = F.col("_before").isNotNull()
    joined = join_on_hot_key(hashed, firsts, "text_hash", "copies", key)
    later = known | (F.col(key) != F.col("_first.first_key"))
    return joined.select(
        key,
        "text_hash",
        later.alias("is_duplicate"),
        F.when(later, 1.0).otherwise(0.0).alias("duplicate_score"),
        F.when(later, F.col("_first.first_seen")).alias("first_seen"),
    )


def mark_duplicates(
    df: DataFrame, key: str, text: str = "text", first_seen: str | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """Flag every text that an earlier row (by ``key``) already had. Only (key, hash) is shuffled; ``seen`` as in ``mark_hashed``."""
    return mark_hashed(hashed_texts(df, key, text, first_seen), key, seen)


def full_analysis(df: DataFrame, key: str, text: str = "text", as_of: Column | None = None) -> DataFrame:
    """One row per document: ``analyse`` plus the duplicate score; short texts are never duplicates."""
    marks = mark_duplicates(df.filter(~tx.too_short(F.col(text))), key, text)
    score = F.struct("is_duplicate", "duplicate_score", "first_seen").alias("duplicate_score")
    analysed = analyse(df, text, as_of).drop("tokens", "sentences")
    # Only duplicates need their row; few of them are sent to the analysed rows, which then stay where they are.
    later = materialize(marks.filter("is_duplicate").select(key, score), "duplicates")
    later = F.broadcast(later) if later.count() <= BROADCAST_ROWS else later
    joined = analysed.join(later, key, "left")
    none = F.struct(
        F.lit(False).alias("is_duplicate"), F.lit(0.0).alias("duplicate_score"),
        F.lit(None).cast(df.schema[key].dataType).alias("first_seen"),
    )
    return joined.withColumn("duplicate_score", F.coalesce("duplicate_score", none))


def clean_record(
    df: DataFrame,
    content: str | None = None,
    as_of: Column | None = None,
    max_headings: int | None = None,
    max_paragraphs: int | None = None,
) -> DataFrame:
    """Submitted documents cleaned for storage, whole unless limits are given; counts are those before any limit."""
    heads = F.filter(F.transform(F.col("headings"), tx.clean_for_storage), lambda h: F.length(h) > 3)
    paras = F.filter(F.transform(F.col("paragraphs"), tx.clean_for_storage), lambda p: F.length(p) > 20)
    empty = F.array().cast("array<string>")
    kept = df.withColumn("_heads", F.coalesce(heads, empty)).withColumn("_paras", F.coalesce(paras, empty))
    length = F.coalesce(F.length(F.col(content)), F.lit(0)) if content else F.lit(0)
    meta = F.col("meta") if "meta" in df.columns else F.create_map().cast("map<string,string>")
    keys = [c for c in ("id", "user_id", "created_at") if c in df.columns]
    return kept.select(
        *keys,
        F.coalesce("url", F.lit("")).alias("url"),
        tx.clean_for_storage(F.col("title")).alias("title"),
        (F.slice("_heads", 1, max_headings) if max_headings else F.col("_heads")).alias("headings"),
        (F.slice("_paras", 1, max_paragraphs) if max_paragraphs else F.col("_paras")).alias("paragraphs"),
        meta.alias("meta"),
        (as_of if as_of is not None else F.current_timestamp()).alias("processed_at"),
        length.cast("long").alias("content_length"),
        F.size("_heads").cast("long").alias("headings_count"),
        F.size("_paras").cast("long").alias("paragraphs_count"),
    )
