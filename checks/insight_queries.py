"""Crawl graph, corpus insights and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import page_queries as pq, text_queries as tq
from checks.metric_queries import r, rounded
from checks.page_queries import SQL_LINKS, SQL_PAGES, SQL_PARAS, per_part, web_clean
from checks.text_queries import sql_list, sql_strip
from pagemill import fixed_values as fixed
from pagemill.functions import urls
from pagemill.functions.common import unnest
from pagemill.operators import corpus, crawl, documents as docs, pages as pg, recommend as rec
from pagemill.plans.stored import materialize
from checks import views

DEPTH, MAX_PAGES = 6, 40


def bfs_levels(spark, folder):
    """One crawl per nation over the part link graph."""
    links = views.part_links(spark, folder)
    nation = views.table(spark, folder, "nation")
    seeds = nation.select(F.col("n_nationkey").cast("long").alias("crawl_id"), (F.col("n_nationkey") * 3).cast("long").alias("url"))
    return crawl.breadth_first(links, seeds, DEPTH, MAX_PAGES).withColumn("level", F.col("level").cast("long"))


def page_link_rows(spark, folder):
    links = pg.links(pq.els(), F.col("url"), "api")
    df = unnest(pq.parsed(spark, folder), ["page_id", F.col("url").alias("src")], links, "l", "link_seq")
    return df.select("page_id", "src", F.col("link_seq").cast("long").alias("link_seq"), F.col("l.url").alias("dst"), "l.text")


def bounded_crawl(spark, folder):
    links = page_link_rows(spark, folder).select(F.col("page_id").alias("src"), "link_seq", "dst", F.col("src").alias("page_url"))
    seeds = pq.raw(spark, folder).select(F.col("page_id").alias("crawl_id"), "url")
    keyed = links.select(F.col("page_url").alias("src"), "link_seq", "dst")
    return crawl.bounded_crawl(keyed, seeds, max_pages=5).withColumn("position", F.col("position").cast("long"))


def requests(spark, folder):
    """Every page URL asked for twice, and a media file per page; every fifth page fails."""
    status = F.element_at(F.array(*[F.lit(c) for c in (200, 404, 200, 403, 500, 503, 200)]), (F.col("page_id") % 7 + 1).cast("int"))
    kinds = F.posexplode(F.array(F.lit(""), F.lit("#again"), F.lit(".pdf"))).alias("k", "suffix")
    df = pq.raw(spark, folder).select("page_id", "url", status.cast("long").alias("status_code"), kinds)
    return df.select((F.col("page_id") * 3 + F.col("k")).alias("seq"), F.concat("url", "suffix").alias("url"), "status_code")


def visited_dedupe(spark, folder):
    return crawl.first_visits(requests(spark, folder), "seq").select("normalized", "seq", "url")


def outcomes(spark, folder):
    return crawl.outcomes(requests(spark, folder), "seq")


def outcome_split(spark, folder):
    done, failed = crawl.split_outcomes(crawl.outcomes(requests(spark, folder), "seq"))
    good = done.agg(F.count("*").alias("rows")).select(F.lit("success").alias("outcome"), F.lit("").alias("error"), "rows")
    bad = failed.groupBy("error").agg(F.count("*").alias("rows")).select(F.lit("error").alias("outcome"), "error", "rows")
    return good.unionByName(bad)


def crawl_records(spark, folder, profile="crawl", caps=None):
    df = pg.extract(pq.corpus(spark, folder), profile, caps=caps)
    return df.withColumn("crawl_id", urls.domain(F.col("url")))


def crawl_summary(spark, folder):
    return crawl.crawl_summary(crawl_records(spark, folder))


def crawl_summary_capped(spark, folder):
    return crawl.crawl_summary(crawl_records(spark, folder, "basic", pg.CAPS["basic"]), capped=True)


def run_lists(spark, folder):
    wanted = requests(spark, folder).select((F.col("seq") % 4).alias("run_id"), F.col("seq").alias("url_no"), "url")
    results = pq.raw(spark, folder).groupBy("url").agg(F.min("page_id").alias("p")).select(
        "url", F.when(F.col("p") % 5 == 0, "HTTP 503").alias("error")
    )
    return crawl.run_report(wanted, results)


def run_report(spark, folder):
    return run_lists(spark, folder)[1]


def run_report_detail(spark, folder):
    return run_lists(spark, folder)[0]


def outcome_detail(spark, folder):
    out = pg.extract(pq.catalog(spark, folder), "enhanced")
    return rounded(crawl.outcome_detail(out, "page_id"), "quality_score")


def analysed_documents(spark, folder):
    return docs.analyse(tq.documents(spark, folder)).select("doc_id", "source", "topics", "sentiment", "content_type")


def topic_rollup(spark, folder):
    return rounded(corpus.dominant_topics(analysed_documents(spark, folder), "doc_id"), "total_confidence")


def topic_rollup_by_source(spark, folder):
    out = corpus.dominant_topics(analysed_documents(spark, folder), "doc_id", ["source"])
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "total_confidence")


def sentiment_mean(spark, folder):
    return corpus.average_sentiment(analysed_documents(spark, folder), ["source"])


def type_distribution(spark, folder):
    return corpus.content_type_distribution(analysed_documents(spark, folder))


def page_texts(spark, folder):
    return corpus.page_texts(crawl_records(spark, folder), "crawl_id", "page_id")


def page_topics(spark, folder):
    """Dominant topics of the page corpus."""
    analysed = docs.analyse(page_texts(spark, folder)).select("page_id", "topics")
    return rounded(corpus.dominant_topics(analysed, "page_id"), "total_confidence")


def _flat(analysis, key):
    return analysis.select(
        key, "pages", "basic_stats.total_words", "basic_stats.unique_words", "basic_stats.avg_word_length",
        "basic_stats.avg_sentence_length", "basic_stats.vocabulary_diversity",
        F.array_join(F.transform("basic_stats.most_common_words", lambda w: F.concat(w["word"], F.lit(":"), w["count"])), " ").alias("top_words"),
        "readability.flesch_reading_ease", "readability.readability_level", F.col("sentiment.score").alias("sentiment_score"),
        F.array_join(F.transform("topics", lambda t: t["topic"]), " ").alias("topics"),
        F.array_join(F.transform("keywords", lambda k: F.concat(k["word"], F.lit(":"), k["frequency"])), " ").alias("keywords"),
        "content_type.primary_type", "language_detection.detected_language", "summary.summary", "text_length", "sentence_count",
    )


def combined_pages(spark, folder):
    texts = materialize(page_texts(spark, folder), "texts")
    return _flat(corpus.combined_analysis(texts, "crawl_id", "page_id"), "crawl_id")


def combined_sources(spark, folder):
    """Every source's documents as one text; documents stand for pages with only a paragraph."""
    text = F.concat(F.lit("  "), F.col("text"))
    texts = tq.documents(spark, folder).select("source", "doc_id", text.alias("text"))
    return _flat(corpus.combined_analysis(texts, "source", "doc_id"), "source")


def combined_entities(spark, folder):
    return corpus.combined_entities(tq.documents(spark, folder), "source")


def catalog_records(spark, folder):
    """Product pages as crawls by brand."""
    brand = views.table(spark, folder, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("brand"))
    records = pg.extract(pq.catalog(spark, folder), "crawl").select("page_id", "title", "headings", "paragraphs", "links")
    # Estimates take links made from narrow rows for small and would broadcast those of all pages: both sides are sorted instead.
    return records.join(brand.hint("merge"), "page_id")


def catalog_links(records):
    return unnest(records, ["brand", "page_id"], "links", "l").select(
        "brand", F.struct("page_id", "pos").alias("at"), "l.url", "l.text"
    )


def catalog_combined(records):
    return corpus.combined_analysis(corpus.page_texts(records, "brand", "page_id"), "brand", "page_id")


def catalog_analysis(spark, folder):
    return _flat(catalog_combined(materialize(catalog_records(spark, folder), "catalog")), "brand")


def key_terms(spark, folder):
    analysis = catalog_combined(materialize(catalog_records(spark, folder), "catalog"))
    terms = rec.key_terms(F.col("topics"), F.col("keywords"))
    return unnest(analysis, ["brand"], terms, "term").select("brand", "term")


def link_first_per_domain(spark, folder):
    out = rec.first_link_per_domain(catalog_links(catalog_records(spark, folder)), "brand", "at")
    return out.select("brand", "domain", F.col("at.page_id").alias("page_id"), "url", "text")


def _scored(spark, folder):
    records = materialize(catalog_records(spark, folder), "catalog")
    return rec.scored_links(catalog_links(records), catalog_combined(records), "brand", "at")


def link_scores(spark, folder):
    return _scored(spark, folder).select("brand", "domain", "url", "text", "relevance_score", "reasoning")


def link_recommendations(spark, folder):
    out = rec.top_recommendations(_scored(spark, folder), "brand", "at")
    return out.select("brand", F.col("rank").cast("long").alias("rank"), "url", "relevance_score")


def link_outcomes(spark, folder):
    """Every brand as a crawl, and one more without any page."""
    records = materialize(catalog_records(spark, folder), "catalog")
    links, analysis = catalog_links(records), materialize(catalog_combined(records), "combined")
    known = analysis.select("brand", F.lit(True).alias("analysed"))
    crawls = known.unionByName(spark.range(1).select(F.lit("Brand#none").alias("brand"), F.lit(False).alias("analysed")))
    out = rec.recommendation_outcomes(crawls, rec.scored_links(links, analysis, "brand", "at"), rec.link_totals(links, "brand"), "brand", "at")
    urls_ = F.array_join(F.transform("recommended_urls", lambda u: u["url"]), " ")
    return out.select("brand", urls_.alias("urls"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), "total_links_analyzed", "unique_domains_found")


def link_totals(spark, folder):
    return rec.link_totals(catalog_links(catalog_records(spark, folder)), "brand")


def link_categories(spark, folder):
    """Links of every page by kind, against the page's own URL."""
    links = page_link_rows(spark, folder)
    kind = urls.link_type(F.col("dst"), F.col("src"))
    catalog = pg.extract(pq.catalog(spark, folder), "enhanced")
    catalog = unnest(catalog, [], "links", "l").select(F.col("l.type").alias("type"))
    own = links.select(kind.alias("type")).groupBy("type").agg(F.count("*").alias("links")).withColumn("corpus", F.lit("pages"))
    shop = catalog.groupBy("type").agg(F.count("*").alias("links")).withColumn("corpus", F.lit("catalog"))
    return own.unionByName(shop)


def _document_view(spark, folder):
    """Each document as a crawl of its own."""
    return docs.analyse(tq.documents(spark, folder)).select("doc_id", "topics", "keywords", "content_type")


def learning_path(spark, folder):
    out = rec.learning_path(_document_view(spark, folder), "doc_id")
    return out.select("doc_id", "step_no", "step", "description", F.array_join("search_terms", "|").alias("search_terms"))


def search_suggestions(spark, folder):
    found = rec.search_suggestions(F.col("topics"), F.col("keywords"), F.col("content_type.primary_type"))
    df = unnest(_document_view(spark, folder), ["doc_id"], found, "query", "rank")
    return df.select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "query")


def strategy(spark, folder):
    s = rec.strategy(F.col("topics"), F.col("content_type.primary_type"))
    df = _document_view(spark, folder).select("doc_id", s.alias("s"))
    return df.select(
        "doc_id", "s.approach", F.array_join("s.primary_factors", ", ").alias("primary_factors"), "s.content_type",
        "s.dominant_topic", "s.focus",
    )


QUERIES = {
    "bfs_levels": bfs_levels, "bounded_crawl": bounded_crawl, "visited_dedupe": visited_dedupe, "outcomes": outcomes,
    "outcome_split": outcome_split, "crawl_summary": crawl_summary, "crawl_summary_capped": crawl_summary_capped,
    "run_report": run_report, "run_report_detail": run_report_detail, "outcome_detail": outcome_detail,
    "topic_rollup": topic_rollup, "topic_rollup_by_source": topic_rollup_by_source, "sentiment_mean": sentiment_mean,
    "type_distribution": type_distribution, "page_topics": page_topics, "combined_pages": combined_pages,
    "combined_sources": combined_sources, "combined_entities": combined_entities, "catalog_analysis": catalog_analysis,
    "key_terms": key_terms, "link_first_per_domain": link_first_per_domain, "link_scores": link_scores,
    "link_recommendations": link_recommendations, "link_totals": link_totals, "link_outcomes": link_outcomes, "link_categories": link_categories,
    "learning_path": learning_path, "search_suggestions": search_suggestions, "recommendation_strategy": strategy,
}

SQL_REQUESTS = f"""
    rq AS (
      SELECT page_id * 3 + k AS seq, url || ['', '#again', '.pdf'][k + 1] AS url, k, normalized,
        [200, 404, 200, 403, 500, 503, 200][page_id % 7 + 1]::BIGINT AS status_code
      FROM (SELECT *, unnest([0, 1, 2]) AS k FROM nm)
    ),
    rn AS (
      SELECT seq, url, status_code, CASE WHEN k < 2 OR contains(url, '#') THEN normalized
          WHEN contains(url, '?') THEN normalized || '.pdf'
          ELSE regexp_replace(url, '^([a-z]+)://(www\\.)?', '\\1://') END AS normalized FROM rq
    ),
    fx AS (SELECT *, regexp_matches(normalized, '\\.pdf$') AS excluded, min(seq) OVER (PARTITION BY normalized) AS first FROM rn),
    oc AS (SELECT *, CASE WHEN excluded THEN 'URL excluded by pattern' WHEN seq <> first THEN 'Already visited'
             WHEN status_code = 404 THEN 'Page not found' WHEN status_code = 403 THEN 'Access forbidden' WHEN status_code = 500 THEN 'Server error'
             WHEN status_code <> 200 THEN 'HTTP ' || status_code END AS error FROM fx)"""
SQL_CRAWL_COUNTS = f"""
    np AS (SELECT page_id, count(*) AS n FROM basic GROUP BY page_id),
    nl AS (SELECT page_id, count(*) FILTER (WHERE starts_with(href, '/') AND {sql_strip('text')} <> '') AS n FROM hrefs GROUP BY page_id)"""
SQL_PAGE_TEXT = f"""
    ptext AS (
      SELECT pg.page_id, host AS crawl_id, {sql_strip('title')} || ' ' || CASE WHEN length({sql_strip('h1')}) > 2 THEN {sql_strip('h1')} ELSE '' END
        || ' ' || coalesce(b.text, '') AS text
      FROM pg LEFT JOIN (SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS text FROM basic GROUP BY page_id) b USING (page_id)
    )"""


def sql_rollup(keys: str = "") -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    cols = keys + ", " if keys else ""
    return f"""
    roll AS (
      SELECT {cols}topic, count(*) AS pages, sum(confidence) AS conf, min((doc_id, rank)) AS seen FROM t
      {"JOIN (SELECT doc_id, source FROM documents) s USING (doc_id)" if keys else ""}
      WHERE doc_id IN (SELECT doc_id FROM d WHERE trimmed >= 10) GROUP BY ALL
    ),
    top AS (SELECT *, row_number() OVER ({over} ORDER BY pages DESC, seen) AS rank FROM roll QUALIFY rank <= 5)"""


def sql_combined(source: str, key: str) -> str:
    """Combined analysis the direct way: join all texts of a crawl, then analyse the result."""
    return "WITH " + source + f"""
    joined AS (SELECT {key} AS doc_id, string_agg(text || ' ', '' ORDER BY page_id) AS text, count(*) AS pages FROM src GROUP BY 1),
    {tq.sql_docs("joined")}, {tq.SQL_RANKED}, {tq.sql_topics()}, {tq.sql_types()}, {tq.SQL_SUMMARY},
    base AS (SELECT d.*, {tq.SQL_EASE} AS ease, {tq.SQL_POSITIVE} AS p, {tq.SQL_NEGATIVE} AS q, {tq.SQL_ENGLISH} AS e, {tq.SQL_SPANISH} AS s FROM d),
    tw AS (SELECT doc_id, string_agg(word || ':' || c, ' ' ORDER BY rank) AS w FROM ranked WHERE rank <= 10 GROUP BY doc_id),
    kx AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS place FROM ranked WHERE rank <= 20 AND c > 1 QUALIFY place <= 10),
    kw AS (SELECT doc_id, string_agg(word || ':' || c, ' ' ORDER BY place) AS w, list(word ORDER BY place) AS ws FROM kx GROUP BY doc_id),
    tp AS (SELECT doc_id, string_agg(topic, ' ' ORDER BY rank) AS w, list(topic ORDER BY rank)[1:3] AS ws FROM t GROUP BY doc_id),
    res AS (
      SELECT b.doc_id, j.pages, CAST(n AS BIGINT) AS total_words, CAST(len(list_distinct(words)) AS BIGINT) AS unique_words,
        {r("list_sum(list_transform(words, lambda w: length(w)))::DOUBLE / n", 2)} AS avg_word_length,
        {r("n::DOUBLE / b.m", 2)} AS avg_sentence_length, {r("len(list_distinct(words))::DOUBLE / n", 3)} AS vocabulary_diversity,
        tw.w AS top_words, {r("greatest(0.0::DOUBLE, least(100.0::DOUBLE, ease))", 1)} AS flesch_reading_ease, {tq.SQL_LEVEL} AS readability_level,
        {r("(p - q)::DOUBLE / n", 3)} AS sentiment_score, coalesce(tp.w, '') AS topics, coalesce(kw.w, '') AS keywords, c.primary_type,
        CASE WHEN e > b.s THEN 'english' WHEN b.s > e THEN 'spanish' ELSE 'unknown' END AS detected_language,
        sm.summary, CAST(length(b.text) AS BIGINT) AS text_length, CAST(b.m AS BIGINT) AS sentence_count
      FROM base b JOIN joined j USING (doc_id) JOIN c USING (doc_id) JOIN sm USING (doc_id) LEFT JOIN tw USING (doc_id)
      LEFT JOIN kw USING (doc_id) LEFT JOIN tp USING (doc_id)
    )"""


CATALOG_SOURCE = """
    src AS (
      SELECT p_partkey AS page_id, p_brand AS brand, p_name || ' Offer ' || p_brand || ' ' || p_name || ' by ' || p_brand || ' The ' || p_name ||
        ' is a ' || p_type || ' part of size ' || p_size || ' made by ' || p_brand || '.' AS text
      FROM part
    ),"""
SQL_CATALOG_LINKS = """
    lk AS (
      SELECT p_brand AS brand, p_partkey AS page_id, 0 AS pos, 'https://www.Shop.example/home' AS url, 'home' AS text FROM part
      UNION ALL SELECT p_brand, p_partkey, 1, 'https://vendor' || p_size || '.example/a', p_name || [' part guide', ' click here for more', ' offer'][p_size % 3 + 1] FROM part
    ),
    fl AS (SELECT *, regexp_extract(url, '://([^/]*)', 1) AS domain, row_number() OVER (PARTITION BY brand, regexp_extract(url, '://([^/]*)', 1) ORDER BY page_id, pos) AS nth
           FROM lk QUALIFY nth = 1)"""
CATALOG = sql_combined(CATALOG_SOURCE, "brand") + ", " + SQL_CATALOG_LINKS


def times(step: str, n: str) -> str:
    return f"list_transform(range(0, {n}), lambda i: {step}::DOUBLE)"


def contained(terms: str, text: str) -> str:
    return f"list_filter({terms}, lambda k: contains({text}, k))"


SQL_SCORED = f"""
    about AS (SELECT doc_id AS brand, list_distinct(list_concat(coalesce(tp.ws, []), coalesce(kw.ws, []))) AS terms, primary_type
              FROM res LEFT JOIN tp USING (doc_id) LEFT JOIN kw USING (doc_id)),
    steps AS (
      SELECT fl.*, terms, primary_type, list_concat([0.0::DOUBLE],
        {times('0.3', f"len({contained('terms', 'text')})")}, {times('0.2', f"len({contained('terms', 'lower(url)')})")},
        {times('0.15', "CASE primary_type " + " ".join(f"WHEN '{k}' THEN len(list_filter({sql_list(w)}, lambda k: contains(text, k) OR contains(lower(url), k)))" for k, w in fixed.LINK_TYPE_TERMS.items()) + " ELSE 0 END")},
        {times('0.1', f"len({contained(sql_list(fixed.EDUCATIONAL_TERMS), 'text')})")},
        {times('-0.1', f"len({contained(sql_list(fixed.LOW_QUALITY_TERMS), 'text')})")}) AS points
      FROM fl JOIN about USING (brand)
    ),
    linked AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_reduce(points, lambda a, b: a + b))) AS score FROM steps),
    kept AS (
      SELECT brand, domain, url, text, page_id, pos, {r('score', 3)} AS relevance_score,
        CASE WHEN len({contained('terms', 'text')}) > 0 THEN 'Contains key topics: ' || array_to_string(list_sort({contained('terms', 'text')})[1:3], ', ')
             ELSE 'Contextually related to current topic' END AS reasoning
      FROM linked WHERE score > 0.1::DOUBLE
    )"""
SQL_DOC_FACTS = tq.sql_with(
    tq.sql_docs(), tq.SQL_RANKED, tq.sql_topics(), tq.sql_types(),
    """facts AS (
      SELECT d.doc_id, CASE WHEN trimmed >= 10 THEN tp.topic END AS topic, CASE WHEN trimmed >= 10 THEN kw.word END AS word,
        CASE WHEN trimmed >= 10 THEN fk.word END AS frequent, primary_type
      FROM (SELECT doc_id, trimmed FROM d) d JOIN (SELECT doc_id, primary_type FROM c) c USING (doc_id)
      LEFT JOIN (SELECT doc_id, topic FROM t WHERE rank = 1) tp USING (doc_id)
      LEFT JOIN (SELECT doc_id, word FROM ranked WHERE rank = 1 AND c > 1) kw USING (doc_id)
      LEFT JOIN (SELECT doc_id, word FROM ranked WHERE rank = 1 AND c > 2) fk USING (doc_id)
    )""",
    select="",
)


def sql_steps() -> str:
    rows = []
    for topic, steps in [*fixed.LEARNING_STEPS.items(), ("", fixed.LEARNING_STEPS_GENERIC)]:
        for no, (step, text, terms) in enumerate(steps, 1):
            quote = lambda v: "'" + v.replace("'", "''") + "'"
            rows.append(f"({quote(topic)}, {no}::BIGINT, {quote(step)}, {quote(text)}, {quote('|'.join(terms))})")
    return "steps(topic, step_no, step, description, search_terms) AS (VALUES " + ", ".join(rows) + ")"


def sql_template(template: str) -> str:
    return f"replace(replace('{template}', '{{topic}}', topic), '{{keyword}}', coalesce(frequent, ''))"


SQL_SUGGEST = (
    "list_concat(CASE WHEN frequent IS NOT NULL THEN [" + ", ".join(map(sql_template, fixed.SEARCH_KEYWORD_TEMPLATES)) + "] ELSE [] END, CASE primary_type "
    + " ".join(f"WHEN '{k}' THEN [" + ", ".join(map(sql_template, ts)) + "]" for k, ts in fixed.SEARCH_TYPE_TEMPLATES.items()) + " ELSE [] END)[1:8]"
)

ORACLES = {
    "bfs_levels": f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM part),
        e AS (SELECT p_partkey AS src, (p_partkey * 7 + 1) % n AS dst FROM part, n UNION ALL SELECT p_partkey, (p_partkey * 3 + 2) % n FROM part, n),
        b AS (SELECT n_nationkey::BIGINT AS crawl_id, (n_nationkey * 3)::BIGINT AS url, 0::BIGINT AS level FROM nation
              UNION SELECT crawl_id, dst, level + 1 FROM b JOIN e ON url = src WHERE level + 1 < {DEPTH}),
        m AS (SELECT crawl_id, url, min(level) AS level FROM b GROUP BY 1, 2),
        c AS (SELECT crawl_id, level, count(*) AS n FROM m GROUP BY 1, 2),
        g AS (SELECT crawl_id, level, coalesce(sum(n) OVER (PARTITION BY crawl_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
        SELECT m.crawl_id, m.url, m.level FROM m JOIN g USING (crawl_id, level) WHERE before < {MAX_PAGES}""",
    "bounded_crawl": f"""WITH {SQL_PAGES}, {SQL_LINKS},
        l AS (SELECT h.page_id, h.k, scheme || '://' || host || href AS dst, p.url FROM hrefs h JOIN (SELECT page_id, url FROM pages) p USING (page_id)
              WHERE starts_with(href, '/') AND {sql_strip('text')} <> ''),
        same AS (SELECT a.page_id AS crawl_id, b.dst, b.k FROM pages a JOIN l b ON b.url = a.url),
        o AS (SELECT crawl_id, dst, min(k) AS k FROM same GROUP BY 1, 2),
        rk AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY k, dst) AS position FROM o)
        SELECT page_id AS crawl_id, 0::BIGINT AS position, url FROM pages UNION ALL SELECT crawl_id, position, dst FROM rk WHERE position < 5""",
    "visited_dedupe": f"WITH {SQL_PAGES}, {SQL_REQUESTS} SELECT normalized, min(seq) AS seq, arg_min(url, seq) AS url FROM rn GROUP BY normalized",
    "outcomes": f"""WITH {SQL_PAGES}, {SQL_REQUESTS} SELECT seq, CASE WHEN excluded OR seq <> first THEN url ELSE normalized END AS url,
        CASE WHEN NOT (excluded OR seq <> first) THEN status_code END AS status_code, error FROM oc""",
    "outcome_split": f"""WITH {SQL_PAGES}, {SQL_REQUESTS} SELECT CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS outcome,
        coalesce(error, '') AS error, count(*) AS rows FROM oc GROUP BY 1, 2""",
    "crawl_summary": f"""WITH {SQL_PAGES}, {SQL_PARAS}, {SQL_LINKS}, {SQL_CRAWL_COUNTS}
        SELECT host AS crawl_id, count(*) AS total_pages, CAST(sum(CASE WHEN length({sql_strip('h1')}) > 2 THEN 1 ELSE 0 END) AS BIGINT) AS total_headings,
          CAST(sum(coalesce(np.n, 0)) AS BIGINT) AS total_paragraphs, CAST(sum(coalesce(nl.n, 0)) AS BIGINT) AS total_links, 0::BIGINT AS total_images,
          CAST(sum(length(html)) AS BIGINT) AS total_content_length
        FROM pg LEFT JOIN np USING (page_id) LEFT JOIN nl USING (page_id) GROUP BY 1""",
    "crawl_summary_capped": f"""WITH {SQL_PAGES}, {SQL_PARAS}, np AS (SELECT page_id, count(*) AS n FROM basic GROUP BY page_id)
        SELECT host AS crawl_id, count(*) AS total_pages, count(*) AS total_headings, CAST(sum(least(50, coalesce(np.n, 0))) AS BIGINT) AS total_paragraphs,
          0::BIGINT AS total_links, 0::BIGINT AS total_images, CAST(sum(length(html)) AS BIGINT) AS total_content_length
        FROM pg LEFT JOIN np USING (page_id) GROUP BY 1""",
    "run_report": f"""WITH {SQL_PAGES}, {SQL_REQUESTS}, res AS (SELECT url, min(page_id) AS p FROM pages GROUP BY url),
        dt AS (SELECT seq % 4 AS run_id, p IS NOT NULL AND p % 5 <> 0 AS good FROM rq LEFT JOIN res USING (url))
        SELECT run_id, 'completed' AS status, count(*) AS total_urls, count(*) FILTER (WHERE good) AS succeeded, count(*) FILTER (WHERE NOT good) AS failed FROM dt GROUP BY 1""",
    "run_report_detail": f"""WITH {SQL_PAGES}, {SQL_REQUESTS}, res AS (SELECT url, min(page_id) AS p FROM pages GROUP BY url)
        SELECT seq % 4 AS run_id, seq AS url_no, url, CASE WHEN p IS NOT NULL AND p % 5 <> 0 THEN 'completed' ELSE 'failed' END AS status,
          CASE WHEN p IS NULL THEN 'No result' WHEN p % 5 = 0 THEN 'HTTP 503' END AS error FROM rq LEFT JOIN res USING (url)""",
    "outcome_detail": f"""WITH x AS (SELECT *, 'The ' || p_name || ' is a ' || p_type || ' part of size ' || p_size || ' made by ' || p_brand || '.' AS para FROM part)
        SELECT p_partkey AS page_id, p_name AS title, {r('''CASE WHEN length(p_name) > 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN length(para) > 100 THEN 0.1::DOUBLE ELSE 0 END + 0.2::DOUBLE + 0.2::DOUBLE
          + CASE WHEN length(para)::DOUBLE / hl > 0.1 THEN 0.1::DOUBLE WHEN length(para)::DOUBLE / hl > 0.05 THEN 0.05 ELSE 0 END''')} AS quality_score,
          2::BIGINT AS headings_count, 1::BIGINT AS paragraphs_count, 3::BIGINT AS links_count, 1::BIGINT AS internal_links
        FROM (SELECT *, 2100 AS hl FROM x)""",
    "topic_rollup": tq.sql_with(tq.sql_docs(), tq.sql_topics(), sql_rollup(), select=f"SELECT topic, pages, {r('conf')} AS total_confidence FROM top"),
    "topic_rollup_by_source": tq.sql_with(
        tq.sql_docs(), tq.sql_topics(), sql_rollup("source"),
        select=f"SELECT source, topic, pages, CAST(rank AS BIGINT) AS rank, {r('conf')} AS total_confidence FROM top",
    ),
    "sentiment_mean": tq.sql_with(
        tq.sql_docs(), f"x AS (SELECT doc_id, CASE WHEN trimmed < 10 OR n = 0 THEN 0.0::DOUBLE ELSE {r(f'({tq.SQL_POSITIVE} - {tq.SQL_NEGATIVE})::DOUBLE / n', 3)} END AS score FROM d)",
        select=f"SELECT source, {r('avg(score)', 3)} AS average_sentiment, count(*) AS total_pages_analyzed FROM x JOIN documents USING (doc_id) GROUP BY source",
    ),
    "type_distribution": tq.sql_with(tq.sql_docs(), tq.sql_types(), select="SELECT primary_type AS content_type, count(*) AS pages FROM c GROUP BY 1"),
    "page_topics": f"WITH {SQL_PAGES}, {SQL_PARAS}, {SQL_PAGE_TEXT}, {tq.sql_docs('ptext', 'page_id')}, {tq.sql_topics()}, {sql_rollup()} SELECT topic, pages, {r('conf')} AS total_confidence FROM top",
    "combined_pages": sql_combined(f"{SQL_PAGES}, {SQL_PARAS}, {SQL_PAGE_TEXT}, src AS (SELECT * FROM ptext),", "crawl_id") + " SELECT * RENAME (doc_id AS crawl_id) FROM res",
    "combined_sources": sql_combined("src AS (SELECT doc_id AS page_id, source, '  ' || text AS text FROM documents),", "source") + " SELECT * RENAME (doc_id AS source) FROM res",
    "combined_entities": f"SELECT DISTINCT source, kind, value FROM ({tq.ENTITY_SQL}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)",
    "catalog_analysis": CATALOG + " SELECT * RENAME (doc_id AS brand) FROM res",
    "key_terms": f"{CATALOG}, {SQL_SCORED} SELECT brand, unnest(terms) AS term FROM about",
    "link_first_per_domain": f"{CATALOG} SELECT brand, domain, page_id, url, text FROM fl",
    "link_scores": f"{CATALOG}, {SQL_SCORED} SELECT brand, domain, url, text, relevance_score, reasoning FROM kept",
    "link_recommendations": f"""{CATALOG}, {SQL_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY relevance_score DESC, page_id, pos) AS rank FROM kept QUALIFY rank <= 5)
        SELECT brand, rank, url, relevance_score FROM k""",
    "link_outcomes": f"""{CATALOG}, {SQL_SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY relevance_score DESC, page_id, pos) AS rank FROM kept QUALIFY rank <= 5),
        best AS (SELECT brand, string_agg(url, ' ' ORDER BY rank) AS urls FROM top GROUP BY brand),
        totals AS (SELECT brand, count(*) AS total_links_analyzed, count(DISTINCT regexp_extract(url, '://([^/]*)', 1)) AS unique_domains_found FROM lk GROUP BY 1)
        SELECT brand, coalesce(urls, '') AS urls, '' AS reasoning, total_links_analyzed, unique_domains_found FROM totals LEFT JOIN best USING (brand)
        UNION ALL SELECT 'Brand#none', '', 'Insufficient data for recommendations', 0, 0""",
    "link_totals": f"{CATALOG} SELECT brand, count(*) AS total_links_analyzed, count(DISTINCT regexp_extract(url, '://([^/]*)', 1)) AS unique_domains_found FROM lk GROUP BY 1",
    "link_categories": f"""WITH {SQL_PAGES}, {SQL_LINKS} SELECT 'pages' AS corpus, 'internal' AS type, count(*) AS links FROM hrefs WHERE starts_with(href, '/') AND {sql_strip('text')} <> ''
        UNION ALL SELECT 'catalog', t, count(*) FROM (SELECT unnest(['internal', 'external', 'relative']) AS t FROM part) GROUP BY t""",
    "learning_path": SQL_DOC_FACTS.rstrip() + f""", {sql_steps()}
        SELECT doc_id, step_no, step, description, search_terms FROM facts JOIN steps
          ON steps.topic = CASE WHEN facts.topic IN ({', '.join(repr(k) for k in fixed.LEARNING_STEPS)}) THEN facts.topic ELSE '' END
        WHERE facts.topic IS NOT NULL""",
    "search_suggestions": SQL_DOC_FACTS.rstrip() + f""", q AS (SELECT doc_id, {SQL_SUGGEST} AS qs FROM facts WHERE topic IS NOT NULL AND word IS NOT NULL)
        SELECT doc_id, CAST(generate_subscripts(qs, 1) AS BIGINT) AS rank, unnest(qs) AS query FROM q""",
    "recommendation_strategy": SQL_DOC_FACTS.rstrip() + f""" SELECT doc_id, '{fixed.STRATEGY_APPROACH}' AS approach, '{", ".join(fixed.STRATEGY_FACTORS)}' AS primary_factors,
        primary_type AS content_type, topic AS dominant_topic, CASE WHEN topic IS NOT NULL THEN 'Finding content related to ' || topic
          ELSE 'General content discovery based on keywords' END AS focus FROM facts""",
}
