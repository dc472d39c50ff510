"""Text features over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill import fixed_values as fixed
from pagemill.functions import text as tx
from pagemill.functions.common import unnest
from pagemill.operators import documents as docs
from checks.views import spread, table

SPACE = r"\t-\r\x1C-\x1F\x{85}\p{Z}"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_hits(text: str, words) -> str:
    return f"CAST(len(list_filter({sql_list(words)}, lambda k: contains({text}, k))) AS BIGINT)"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


SQL_WORDS = (
    rf"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{SPACE}]', '', 'g'), "
    rf"'[{SPACE}]+'), lambda w: length(w) > 2)"
)
SQL_SENTENCES = (
    f"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: {sql_strip('s')}), lambda s: s <> '')"
)


def sql_docs(source: str = "documents", key: str = "doc_id") -> str:
    """CTE ``d``: key, text, words, n, sentences, m and vowel runs."""
    return f"""
    d AS (
      SELECT {key} AS doc_id, text, words, len(words) AS n, sents, len(sents) AS m, lower(text) AS low,
             greatest(1, len(regexp_extract_all(lower(text), '[aeiouy]+'))) AS syl,
             length({sql_strip('text')}) AS trimmed
      FROM (SELECT *, {SQL_WORDS} AS words, {SQL_SENTENCES} AS sents FROM {source})
    )"""


SQL_RANKED = """
    freq AS (
      SELECT doc_id, word, any_value(n) AS n, count(*) AS c, min(pos) AS first_pos
      FROM (SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d)
      GROUP BY doc_id, word
    ),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, first_pos) AS rank FROM freq
    )"""


def sql_topics(prefix: str = "") -> str:
    """CTE ``t``: one row per document and topic in the top five."""
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{topic}' AS topic, {place} AS place, {sql_hits('low', words)} AS keyword_matches, "
        f"{len(words)} AS size FROM d"
        for place, (topic, words) in enumerate(fixed.TOPIC_KEYWORDS.items())
    )
    return f"""
    hit AS ({rows}),
    scored AS (
      SELECT doc_id, topic, place, keyword_matches,
             (CAST(printf('%.3f', least(1.0, keyword_matches::DOUBLE / size)) AS DOUBLE) + 0.0::DOUBLE) AS confidence
      FROM hit WHERE keyword_matches > 0
    ),
    t AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, place) AS rank
      FROM scored QUALIFY rank <= 5
    )"""


def sql_types() -> str:
    """CTE ``c``: primary type and confidence per document."""
    scores = [f"{sql_hits('low', words)} AS s_{name}" for name, words in fixed.TYPE_INDICATORS.items()]
    names = list(fixed.TYPE_INDICATORS)
    best = "greatest(" + ", ".join(f"s_{n}" for n in names) + ")"
    cases = " ".join(f"WHEN s_{n} = best THEN '{n}'" for n in names)
    return f"""
    s AS (SELECT doc_id, trimmed, {', '.join(scores)} FROM d),
    b AS (SELECT *, {best} AS best FROM s),
    c AS (
      SELECT *, CASE WHEN trimmed < 10 THEN 'unknown' WHEN best = 0 THEN 'general' {cases} END AS primary_type,
             CASE WHEN trimmed < 10 THEN 0.0 WHEN best = 0 THEN 0.5
                  ELSE (CAST(printf('%.3f', least(1.0, best::DOUBLE / 3)) AS DOUBLE) + 0.0::DOUBLE) END AS type_confidence
      FROM b
    )"""


def documents(spark, folder):
    return spread(table(spark, folder, "documents"))


def basic_stats(spark, folder):
    df = docs.with_tokens(documents(spark, folder))
    stats = tx.basic_stats(F.col("tokens"), F.size("sentences"), F.array().cast(tx.RANKED_TYPE))
    df = df.select("doc_id", stats.alias("s"))
    names = ["total_words", "unique_words", "avg_word_length", "avg_sentence_length", "vocabulary_diversity"]
    return df.select("doc_id", *[F.col(f"s.{n}") for n in names])


def top_words(spark, folder):
    df = docs.with_tokens(documents(spark, folder))
    ranked = df.select("doc_id", tx.top_words(tx.ranked_words(F.col("tokens"), 10)).alias("w"))
    return unnest(ranked, ["doc_id"], "w", "w", "rank").select(
        "doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "w.word", "w.count"
    )


def syllable_counts(spark, folder):
    return documents(spark, folder).select("doc_id", tx.syllables(F.col("text")).cast("long").alias("syllables"))


def readability(spark, folder):
    df = docs.with_tokens(documents(spark, folder))
    r = tx.readability(F.size("tokens"), F.size("sentences"), tx.syllables(F.col("text")))
    return df.select("doc_id", r.alias("r")).select("doc_id", "r.*")


def sentiment(spark, folder):
    df = docs.with_tokens(documents(spark, folder))
    return df.select("doc_id", tx.sentiment(F.col("tokens")).alias("s")).select("doc_id", "s.*")


def topics(spark, folder):
    df = documents(spark, folder).withColumn("low", F.lower("text"))
    df = unnest(df, ["doc_id"], tx.topics(F.col("low")), "t", "rank")
    return df.select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "t.*")


def keywords(spark, folder):
    df = docs.with_tokens(documents(spark, folder))
    words = tx.keywords(tx.ranked_words(F.col("tokens"), 20), F.size("tokens"))
    df = unnest(df, ["doc_id"], words, "k", "rank")
    return df.select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "k.*")


def content_type(spark, folder):
    df = documents(spark, folder).withColumn("low", F.lower("text"))
    df = df.select("doc_id", tx.content_type(F.col("low")).alias("c"))
    scores = [F.coalesce(F.col("c.all_scores")[n], F.lit(0)).cast("long").alias(f"s_{n}") for n in fixed.TYPE_INDICATORS]
    return df.select("doc_id", "c.primary_type", "c.confidence", *scores)


def language(spark, folder):
    df = docs.with_tokens(documents(spark, folder))
    return df.select("doc_id", tx.language(F.col("tokens")).alias("l")).select("doc_id", "l.*")


def sentence_rows(spark, folder):
    df = unnest(documents(spark, folder), ["doc_id"], tx.sentences(F.col("text")), "sentence")
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def token_rows(spark, folder):
    df = unnest(documents(spark, folder), ["doc_id"], tx.tokens(F.col("text")), "word")
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), "word")


def summary(spark, folder):
    df = docs.with_tokens(documents(spark, folder))
    return df.select("doc_id", tx.summary(F.col("text"), F.col("sentences")).alias("s")).select("doc_id", "s.*")


def entities(spark, folder):
    df = documents(spark, folder).select("doc_id", tx.entities(F.col("text")).alias("e"))
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(f"e.{k}").alias("found")) for k in fixed.ENTITY_PATTERNS]
    df = unnest(df, ["doc_id"], F.array(*kinds), "k").select("doc_id", "k.kind", "k.found")
    return unnest(df, ["doc_id", "kind"], "found", "value").select("doc_id", "kind", "value")


def text_clean(spark, folder):
    return documents(spark, folder).select("doc_id", tx.clean_for_storage(F.col("text")).alias("cleaned"))


def gate(spark, folder):
    short = tx.too_short(F.col("text"))
    return documents(spark, folder).groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(short).alias("too_short")
    )


def full_analysis(spark, folder):
    out = docs.full_analysis(documents(spark, folder), "doc_id")
    return out.select(
        "doc_id", "basic_stats.total_words", "basic_stats.unique_words", "readability.flesch_reading_ease",
        "readability.readability_level", F.col("sentiment.score").alias("sentiment_score"),
        F.coalesce(F.get("topics", F.lit(0))["topic"], F.lit("")).alias("top_topic"),
        F.size("topics").cast("long").alias("n_topics"),
        F.coalesce(F.get("keywords", F.lit(0))["word"], F.lit("")).alias("top_keyword"),
        F.size("keywords").cast("long").alias("n_keywords"),
        "content_type.primary_type", "language_detection.detected_language", "duplicate_score.is_duplicate",
        "summary.summary_length", F.size("entities.emails").cast("long").alias("n_emails"), "metadata.text_length",
        "metadata.word_count", "metadata.sentence_count",
    )


def dup_exact(spark, folder):
    return docs.mark_duplicates(documents(spark, folder), "doc_id")


def fingerprint(spark, folder):
    named = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    key = tx.fingerprint("analysis", [F.col("doc_id"), F.col("n_chars")], named)
    return documents(spark, folder).select("doc_id", key.alias("cache_key"))


def clean_record(spark, folder):
    """Documents as submissions: first sentence as title, sentences as headings, lines as paragraphs."""
    sub = documents(spark, folder).select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://docs.example/"), F.col("doc_id")).alias("url"),
        F.get(tx.sentences(F.col("text")), F.lit(0)).alias("title"),
        tx.sentences(F.col("text")).alias("headings"),
        F.split("text", "\n").alias("paragraphs"),
        "text",
    )
    out = docs.clean_record(sub, content="text")
    return out.select(
        F.col("id").alias("doc_id"), "url", "title", F.concat_ws("|", "headings").alias("headings"),
        F.concat_ws("|", "paragraphs").alias("paragraphs"), "content_length", "headings_count", "paragraphs_count",
    )


QUERIES = {
    "text_tokens": token_rows,
    "text_sentences": sentence_rows,
    "text_basic_stats": basic_stats,
    "text_top_words": top_words,
    "text_syllables": syllable_counts,
    "text_readability": readability,
    "text_sentiment": sentiment,
    "text_topics": topics,
    "text_keywords": keywords,
    "text_content_type": content_type,
    "text_language": language,
    "text_summary": summary,
    "text_entities": entities,
    "text_gate": gate,
    "text_clean": text_clean,
    "clean_record": clean_record,
    "full_analysis": full_analysis,
    "dup_exact": dup_exact,
    "fingerprint": fingerprint,
}

SQL_POSITIVE = f"len(list_filter(words, lambda w: list_contains({sql_list(fixed.POSITIVE_WORDS)}, w)))"
SQL_NEGATIVE = f"len(list_filter(words, lambda w: list_contains({sql_list(fixed.NEGATIVE_WORDS)}, w)))"
SQL_ENGLISH = f"len(list_filter(words, lambda w: list_contains({sql_list(fixed.ENGLISH_WORDS)}, w)))"
SQL_SPANISH = f"len(list_filter(words, lambda w: list_contains({sql_list(fixed.SPANISH_WORDS)}, w)))"
SQL_EASE = "206.835::DOUBLE - 1.015::DOUBLE * (n::DOUBLE / m) - 84.6::DOUBLE * (syl::DOUBLE / n)"
SQL_LEVEL = "CASE " + " ".join(f"WHEN ease >= {floor} THEN '{name}'" for floor, name in fixed.READABILITY_BANDS) + (
    f" ELSE '{fixed.READABILITY_LOWEST}' END"
)
SQL_SUMMARY = """
    sm AS (
      SELECT doc_id, text, trimmed, CASE WHEN m <= 3 THEN array_to_string(sents, ' ')
             ELSE concat_ws(' ', sents[1], sents[m // 2 + 1], sents[m]) END AS summary, m
      FROM d
    )"""
SQL_DUP = """
    h AS (SELECT doc_id, md5(text) AS text_hash FROM {source}),
    f AS (SELECT text_hash, min(doc_id) AS first_id FROM h GROUP BY text_hash),
    dup AS (SELECT h.doc_id, h.text_hash, h.doc_id <> f.first_id AS is_duplicate, f.first_id FROM h JOIN f USING (text_hash))
"""


def sql_clean(expr: str) -> str:
    squeezed = f"regexp_replace({expr}, '[{SPACE}]+', ' ', 'g')"
    kept = rf"regexp_replace({sql_strip(squeezed)}, '[^\p{{L}}\p{{N}}_{SPACE}.,!?\-:]', '', 'g')"
    return sql_strip(kept)


def sql_with(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + " " + select


ENTITY_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{pattern}'))) AS value FROM documents"
    for kind, pattern in fixed.ENTITY_PATTERNS.items()
)

ORACLES = {
    "text_tokens": sql_with(
        sql_docs(),
        select="SELECT doc_id, CAST(generate_subscripts(words, 1) - 1 AS BIGINT) AS pos, unnest(words) AS word FROM d",
    ),
    "text_sentences": sql_with(
        sql_docs(),
        select="SELECT doc_id, CAST(generate_subscripts(sents, 1) - 1 AS BIGINT) AS pos, unnest(sents) AS sentence FROM d",
    ),
    "text_basic_stats": sql_with(
        sql_docs(),
        select="""
        SELECT doc_id, CASE WHEN n > 0 THEN CAST(n AS BIGINT) END AS total_words,
          CASE WHEN n > 0 THEN CAST(len(list_distinct(words)) AS BIGINT) END AS unique_words,
          CASE WHEN n > 0 THEN (CAST(printf('%.2f', list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / n) AS DOUBLE) + 0.0::DOUBLE) END AS avg_word_length,
          CASE WHEN n > 0 THEN CASE WHEN m > 0 THEN (CAST(printf('%.2f', n::DOUBLE / m) AS DOUBLE) + 0.0::DOUBLE) ELSE 0.0::DOUBLE END END AS avg_sentence_length,
          CASE WHEN n > 0 THEN (CAST(printf('%.3f', len(list_distinct(words))::DOUBLE / n) AS DOUBLE) + 0.0::DOUBLE) END AS vocabulary_diversity
        FROM d""",
    ),
    "text_top_words": sql_with(
        sql_docs(), SQL_RANKED,
        select="SELECT doc_id, CAST(rank AS BIGINT) AS rank, word, CAST(c AS BIGINT) AS count FROM ranked WHERE rank <= 10",
    ),
    "text_syllables": "SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(lower(text), '[aeiouy]+'))) AS BIGINT) AS syllables FROM documents",
    "text_readability": sql_with(
        sql_docs(), f"e AS (SELECT *, {SQL_EASE} AS ease FROM d)",
        select=f"""
        SELECT doc_id,
          CASE WHEN n > 0 AND m > 0 THEN (CAST(printf('%.1f', greatest(0.0::DOUBLE, least(100.0::DOUBLE, ease))) AS DOUBLE) + 0.0::DOUBLE) END AS flesch_reading_ease,
          CASE WHEN n > 0 AND m > 0 THEN (CAST(printf('%.1f', greatest(0.0::DOUBLE, 0.39::DOUBLE * (n::DOUBLE / m) + 11.8::DOUBLE * (syl::DOUBLE / n)
               - 15.59::DOUBLE)) AS DOUBLE) + 0.0::DOUBLE) END AS flesch_kincaid_grade,
          CASE WHEN n > 0 AND m > 0 THEN {SQL_LEVEL} END AS readability_level
        FROM e""",
    ),
    "text_sentiment": sql_with(
        sql_docs(), f"p AS (SELECT doc_id, n, {SQL_POSITIVE} AS p, {SQL_NEGATIVE} AS q FROM d)",
        select="""
        SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE (CAST(printf('%.3f', (p - q)::DOUBLE / n) AS DOUBLE) + 0.0::DOUBLE) END AS score,
          CASE WHEN n = 0 THEN 'neutral' WHEN (p - q)::DOUBLE / n > 0.05::DOUBLE THEN 'positive'
               WHEN (p - q)::DOUBLE / n < -0.05::DOUBLE THEN 'negative' ELSE 'neutral' END AS label,
          CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE (CAST(printf('%.3f', least(1.0::DOUBLE, (p + q)::DOUBLE / n * 2)) AS DOUBLE) + 0.0::DOUBLE) END AS confidence,
          CAST(p AS BIGINT) AS positive_words, CAST(q AS BIGINT) AS negative_words
        FROM p""",
    ),
    "text_topics": sql_with(
        sql_docs(), sql_topics(),
        select="SELECT doc_id, CAST(rank AS BIGINT) AS rank, topic, confidence, keyword_matches FROM t",
    ),
    "text_keywords": sql_with(
        sql_docs(), SQL_RANKED,
        """k AS (SELECT doc_id, word, c, n, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS place
                 FROM ranked WHERE rank <= 20 AND c > 1 QUALIFY place <= 10)""",
        select="""SELECT doc_id, CAST(place AS BIGINT) AS rank, word, CAST(c AS BIGINT) AS frequency,
                  (CAST(printf('%.4f', (c::DOUBLE / n) * ln(n::DOUBLE / c)) AS DOUBLE) + 0.0::DOUBLE) AS importance FROM k""",
    ),
    "text_content_type": sql_with(
        sql_docs(), sql_types(),
        select="SELECT doc_id, CASE WHEN best = 0 THEN 'general' ELSE primary_type END AS primary_type, "
        "CASE WHEN best = 0 THEN 0.5::DOUBLE ELSE (CAST(printf('%.3f', least(1.0::DOUBLE, best::DOUBLE / 3)) AS DOUBLE) + 0.0::DOUBLE) END AS confidence, "
        + ", ".join(f"s_{n}" for n in fixed.TYPE_INDICATORS) + " FROM c",
    ),
    "text_language": sql_with(
        sql_docs(), f"p AS (SELECT doc_id, n, {SQL_ENGLISH} AS e, {SQL_SPANISH} AS s FROM d)",
        select="""
        SELECT doc_id, CASE WHEN e > s THEN 'english' WHEN s > e THEN 'spanish' ELSE 'unknown' END AS detected_language,
          CASE WHEN e = s THEN 0.5::DOUBLE ELSE (CAST(printf('%.3f', least(1.0::DOUBLE, greatest(e, s)::DOUBLE / n * 2)) AS DOUBLE) + 0.0::DOUBLE) END AS confidence
        FROM p""",
    ),
    "text_summary": sql_with(
        sql_docs(), SQL_SUMMARY,
        select="""SELECT doc_id, summary, CAST(length(summary) AS BIGINT) AS summary_length,
                  CASE WHEN m > 0 THEN (CAST(printf('%.3f', length(summary)::DOUBLE / length(text)) AS DOUBLE) + 0.0::DOUBLE) END AS compression_ratio FROM sm""",
    ),
    "text_entities": ENTITY_SQL,
    "text_gate": f"SELECT source, count(*) AS documents, CAST(count(*) FILTER (WHERE length({sql_strip('text')}) < 10) AS BIGINT) AS too_short FROM documents GROUP BY source",
    "text_clean": f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents",
    "clean_record": f"""
        WITH x AS (
          SELECT doc_id, text, {SQL_SENTENCES} AS sents, string_split(text, chr(10)) AS lines FROM documents),
        y AS (
          SELECT doc_id, text, coalesce({sql_clean('sents[1]')}, '') AS title,
            list_filter(list_transform(sents, lambda v: {sql_clean('v')}), lambda v: length(v) > 3) AS heads,
            list_filter(list_transform(lines, lambda v: {sql_clean('v')}), lambda v: length(v) > 20) AS paras
          FROM x)
        SELECT doc_id, 'https://docs.example/' || doc_id AS url, title,
          array_to_string(heads, '|') AS headings, array_to_string(paras, '|') AS paragraphs,
          CAST(length(text) AS BIGINT) AS content_length, CAST(len(heads) AS BIGINT) AS headings_count,
          CAST(len(paras) AS BIGINT) AS paragraphs_count
        FROM y""",
    "full_analysis": sql_with(
        sql_docs(), SQL_RANKED, sql_topics(), sql_types(), SQL_SUMMARY,
        SQL_DUP.format(source="(SELECT doc_id, text FROM d WHERE trimmed >= 10)"),
        f"""base AS (
          SELECT d.*, {SQL_EASE} AS ease, {SQL_POSITIVE} AS p, {SQL_NEGATIVE} AS q,
            {SQL_ENGLISH} AS e, {SQL_SPANISH} AS s,
            len(list_distinct(regexp_extract_all(text, '{fixed.ENTITY_PATTERNS["emails"]}'))) AS mails
          FROM d)""",
        """kw AS (SELECT doc_id, least(10, count(*)) AS k, arg_min(word, rank) AS w FROM ranked WHERE rank <= 20 AND c > 1 GROUP BY doc_id)""",
        """tp AS (SELECT doc_id, count(*) AS k, arg_min(topic, rank) AS w FROM t GROUP BY doc_id)""",
        select=f"""
        SELECT b.doc_id, CASE WHEN b.trimmed >= 10 AND n > 0 THEN CAST(n AS BIGINT) END AS total_words,
          CASE WHEN b.trimmed >= 10 AND n > 0 THEN CAST(len(list_distinct(words)) AS BIGINT) END AS unique_words,
          CASE WHEN b.trimmed >= 10 AND n > 0 AND b.m > 0 THEN (CAST(printf('%.1f', greatest(0.0::DOUBLE, least(100.0::DOUBLE, ease))) AS DOUBLE) + 0.0::DOUBLE) END AS flesch_reading_ease,
          CASE WHEN b.trimmed >= 10 AND n > 0 AND b.m > 0 THEN {SQL_LEVEL} END AS readability_level,
          CASE WHEN b.trimmed < 10 OR n = 0 THEN 0.0::DOUBLE ELSE (CAST(printf('%.3f', (p - q)::DOUBLE / n) AS DOUBLE) + 0.0::DOUBLE) END AS sentiment_score,
          CASE WHEN b.trimmed < 10 THEN '' ELSE coalesce(tp.w, '') END AS top_topic,
          CASE WHEN b.trimmed < 10 THEN 0 ELSE coalesce(tp.k, 0) END AS n_topics,
          CASE WHEN b.trimmed < 10 THEN '' ELSE coalesce(kw.w, '') END AS top_keyword,
          CASE WHEN b.trimmed < 10 THEN 0 ELSE coalesce(kw.k, 0) END AS n_keywords,
          c.primary_type,
          CASE WHEN b.trimmed < 10 THEN 'unknown' WHEN e > b.s THEN 'english' WHEN b.s > e THEN 'spanish' ELSE 'unknown' END AS detected_language,
          coalesce(dup.is_duplicate, false) AS is_duplicate,
          CASE WHEN b.trimmed < 10 THEN 0 ELSE CAST(length(sm.summary) AS BIGINT) END AS summary_length,
          CASE WHEN b.trimmed < 10 THEN 0 ELSE CAST(mails AS BIGINT) END AS n_emails,
          CASE WHEN b.trimmed >= 10 THEN CAST(length(b.text) AS BIGINT) END AS text_length,
          CASE WHEN b.trimmed >= 10 THEN CAST(n AS BIGINT) END AS word_count,
          CASE WHEN b.trimmed >= 10 THEN CAST(b.m AS BIGINT) END AS sentence_count
        FROM base b JOIN c USING (doc_id) JOIN sm USING (doc_id) LEFT JOIN kw USING (doc_id)
        LEFT JOIN tp USING (doc_id) LEFT JOIN dup USING (doc_id)""",
    ),
    "dup_exact": "WITH " + SQL_DUP.format(source="documents") + """
        SELECT doc_id, text_hash, is_duplicate, CASE WHEN is_duplicate THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS duplicate_score,
          CASE WHEN is_duplicate THEN first_id END AS first_seen FROM dup""",
    "fingerprint": "SELECT doc_id, md5(concat_ws(':', 'analysis', doc_id, n_chars, 'lang:' || lang, 'source:' || source)) AS cache_key FROM documents",
}
