"""URLs and page extraction over ``pages`` and product pages derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.metric_queries import r
from checks.text_queries import SPACE, sql_strip
from pagemill import fixed_values as fixed
from pagemill.functions import urls
from pagemill.functions.common import round_to, unnest
from pagemill.operators import elements as el, pages as pg
from checks import views

HREFS = ["x/y", "../z", "./w/", "?q=1", "//other.example/k", "/abs/./a/../b", "#frag", "mailto:a@b.c", "HTTP://Q.example/u"]


def raw(spark, folder):
    return views.table(spark, folder, "pages")


def corpus(spark, folder):
    return views.spread(raw(spark, folder))


def parsed(spark, folder):
    return el.with_elements(corpus(spark, folder))


def els():
    return F.col("elements")


def exploded(df, column, *keys, name="item"):
    out = unnest(df, list(keys), column, name)
    return out.withColumn("pos", F.col("pos").cast("long"))


def url_normalize(spark, folder):
    return raw(spark, folder).select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


def url_normalize_bare(spark, folder):
    """URLs as people type them: no scheme, mixed case, ``www.``."""
    host = F.concat(F.lit("WWW."), F.initcap(F.parse_url("url", F.lit("HOST"))))
    bare = F.concat(host, F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""))
    return raw(spark, folder).select("page_id", urls.normalize_url(bare).alias("normalized"))


def url_valid(spark, folder):
    url = F.col("url")
    return raw(spark, folder).select(
        "page_id", urls.is_valid_url(url).alias("valid"),
        urls.is_valid_url(url, "cheap-pills.example.com").alias("on_domain"),
        urls.is_valid_url(F.regexp_replace(url, "^https?://", "")).alias("bare_valid"),
    )


def url_exclude(spark, folder):
    """Page URLs with a suffix added by page id."""
    suffixes = F.array(*[F.lit(s) for s in ["", ".pdf", ".PNG", ".tar.gz", ".html", ".mp3", ".docx"]])
    url = F.concat(F.col("url"), F.element_at(suffixes, (F.col("page_id") % 7 + 1).cast("int")))
    return raw(spark, folder).select("page_id", urls.should_exclude_url(url).alias("excluded"))


def url_parts(spark, folder):
    normal = urls.normalize_url(F.col("url"))
    return raw(spark, folder).select("page_id", urls.domain(normal).alias("domain"), urls.path(normal).alias("path"))


def url_resolve(spark, folder):
    hrefs = F.explode(F.array(*[F.lit(h) for h in HREFS])).alias("href")
    df = raw(spark, folder).select("page_id", "url", hrefs)
    return df.select("page_id", "href", urls.resolve_url(F.col("url"), F.col("href")).alias("resolved"))


def url_default_scheme(spark, folder):
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return raw(spark, folder).select("page_id", urls.default_scheme(bare).alias("full"))


def page_elements(spark, folder):
    """Every element of every page: its place in the tree, and a digest of the text inside."""
    rows = el.element_table(corpus(spark, folder), ["page_id"])
    numbers = [F.col(c).cast("long").alias(c) for c in ("seq", "last", "level", "container")]
    return rows.select("page_id", *numbers, "tag", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def page_title(spark, folder):
    return parsed(spark, folder).select(
        "page_id", pg.title(els(), "basic").alias("title"), pg.title(els(), "enhanced").alias("clean_title")
    )


def page_headings(spark, folder):
    df = parsed(spark, folder).select("page_id", pg.headings(els(), "basic").alias("h"))
    return exploded(df, "h", "page_id", name="heading")


def page_headings_enhanced(spark, folder):
    df = parsed(spark, folder).select("page_id", pg.headings(pg.body_elements(els()), "enhanced").alias("h"))
    return exploded(df, "h", "page_id").select(
        "page_id", F.col("item.level").cast("long").alias("level"), F.col("item.text").alias("text")
    )


def page_paragraphs(spark, folder):
    df = parsed(spark, folder).select("page_id", pg.paragraphs(els(), "basic").alias("p"))
    return exploded(df, "p", "page_id", name="paragraph")


def page_paragraphs_enhanced(spark, folder):
    df = parsed(spark, folder).select("page_id", pg.paragraphs(pg.body_elements(els()), "enhanced").alias("p"))
    return exploded(df, "p", "page_id", name="paragraph")


def page_links(spark, folder):
    df = parsed(spark, folder).select("page_id", pg.links(els(), F.col("url"), "api").alias("l"))
    return exploded(df, "l", "page_id").select("page_id", "pos", "item.url", "item.text")


def page_links_enhanced(spark, folder):
    """Links of the whole page, navigation included, normalised and deduplicated."""
    df = parsed(spark, folder).withColumn("base", urls.normalize_url(F.col("url")))
    df = df.select("page_id", pg.links(els(), F.col("base"), "enhanced").alias("l"))
    return exploded(df, "l", "page_id").select("page_id", "pos", "item.url", "item.text", "item.type")


def page_lists(spark, folder):
    df = parsed(spark, folder).select("page_id", pg.lists(els()).alias("l"))
    df = exploded(df, "l", "page_id").select("page_id", "item.type", "item.items")
    return exploded(df, "items", "page_id", "type", name="text")


def page_main_content(spark, folder):
    out = pg.extract(corpus(spark, folder), "enhanced")
    return out.select("page_id", "main_content", "text_length")


def page_quality(spark, folder):
    out = pg.extract(corpus(spark, folder), "enhanced")
    return out.select("page_id", round_to(F.col("quality_score"), 6).alias("quality_score"))


def page_counts(spark, folder):
    out = pg.extract(corpus(spark, folder), "basic")
    return out.select(
        "page_id", "content_length", "headings_count", "paragraphs_count", "links_count", "images_count",
        F.size("paragraphs").cast("long").alias("paragraphs_kept"),
    )


def page_caps(spark, folder):
    out = pg.extract(corpus(spark, folder), "crawl", caps=pg.CAPS["crawl"])
    return out.select(
        "page_id", "links_count", "paragraphs_count", F.size("links").cast("long").alias("links_kept"),
        F.size("paragraphs").cast("long").alias("paragraphs_kept"),
    )


def page_lang(spark, folder):
    df = parsed(spark, folder).select("page_id", pg.document_attributes(els(), F.col("url")).alias("a"))
    return df.select("page_id", "a.language", "a.charset")


def text_clean_web(spark, folder):
    return views.spread(views.table(spark, folder, "documents")).select(
        "doc_id", pg.clean_web_text(F.col("text")).alias("cleaned")
    )


def catalog(spark, folder):
    return views.catalog_pages(spark, folder)


def catalog_parsed(spark, folder):
    return el.with_elements(catalog(spark, folder))


def page_tables(spark, folder):
    df = exploded(catalog_parsed(spark, folder).select("page_id", pg.tables(els()).alias("t")), "t", "page_id", name="block")
    df = df.select("page_id", F.col("pos").alias("table_no"), "block.rows")
    df = unnest(df, ["page_id", "table_no"], "rows", "cells", "row_no")
    return df.select("page_id", "table_no", F.col("row_no").cast("long").alias("row_no"), F.array_join("cells", "|").alias("cells"))


def page_nested_lists(spark, folder):
    df = exploded(catalog_parsed(spark, folder).select("page_id", pg.lists(els()).alias("l")), "l", "page_id")
    return df.select("page_id", "pos", "item.type", F.array_join("item.items", "|").alias("items"))


def page_images(spark, folder):
    base = urls.normalize_url(F.col("url"))
    df = catalog_parsed(spark, folder).select("page_id", pg.images(els(), base, "enhanced").alias("i"))
    return exploded(df, "i", "page_id").select("page_id", "pos", "item.*")


def page_videos(spark, folder):
    base = urls.normalize_url(F.col("url"))
    df = unnest(catalog_parsed(spark, folder), ["page_id"], pg.videos(els(), base), "v")
    df = df.select("page_id", "v.*")
    return unnest(df, ["page_id", "poster", "controls", "autoplay"], "sources", "s").select(
        "page_id", "s.src", "s.type", "poster", "controls", "autoplay"
    )


def _map_rows(df, column):
    return unnest(df, ["page_id"], F.map_entries(column), "e").select("page_id", "e.key", "e.value")


def page_meta(spark, folder):
    return _map_rows(catalog_parsed(spark, folder), pg.meta(els(), "enhanced"))


def page_meta_basic(spark, folder):
    return _map_rows(catalog_parsed(spark, folder), pg.meta(els(), "basic"))


def page_open_graph(spark, folder):
    return _map_rows(catalog_parsed(spark, folder), pg.open_graph(els(), "api"))


def page_twitter(spark, folder):
    return _map_rows(catalog_parsed(spark, folder), pg.twitter_card(els(), "api"))


def page_json_ld(spark, folder):
    df = unnest(catalog_parsed(spark, folder), ["page_id"], pg.json_ld(els()), "v")
    return df.select(
        "page_id", F.variant_get("v", "$.sku", "bigint").alias("sku"), F.variant_get("v", "$.size", "bigint").alias("size")
    )


def page_attributes(spark, folder):
    df = catalog_parsed(spark, folder).select("page_id", pg.document_attributes(els(), F.col("url")).alias("a"))
    return df.select("page_id", "a.*")


def page_headers(spark, folder):
    return catalog(spark, folder).select("page_id", pg.response_headers(F.col("headers")).alias("h")).select("page_id", "h.*")


def catalog_record(spark, folder):
    """The enhanced record of every product page in the common shape, counted."""
    out = pg.common_shape(pg.extract(catalog(spark, folder), "enhanced"))
    return out.select(
        "page_id", "url", "title", F.array_join("headings", "|").alias("headings"),
        F.array_join(F.transform("links", lambda k: k["url"]), " ").alias("link_urls"),
        F.array_join(F.transform("images", lambda i: i["src"]), " ").alias("image_urls"),
        "headings_count", "paragraphs_count", "links_count", "images_count",
    )


QUERIES = {
    "url_normalize": url_normalize, "url_normalize_bare": url_normalize_bare, "url_valid": url_valid, "url_exclude": url_exclude, "url_parts": url_parts,
    "url_resolve": url_resolve, "url_default_scheme": url_default_scheme, "page_elements": page_elements,
    "page_title": page_title, "page_headings": page_headings, "page_headings_enhanced": page_headings_enhanced,
    "page_paragraphs": page_paragraphs, "page_paragraphs_enhanced": page_paragraphs_enhanced,
    "page_links": page_links, "page_links_enhanced": page_links_enhanced, "page_lists": page_lists,
    "page_main_content": page_main_content, "page_quality": page_quality, "page_counts": page_counts,
    "page_caps": page_caps, "page_lang": page_lang, "text_clean_web": text_clean_web, "page_tables": page_tables,
    "page_nested_lists": page_nested_lists, "page_images": page_images, "page_videos": page_videos,
    "page_meta": page_meta, "page_meta_basic": page_meta_basic, "page_open_graph": page_open_graph,
    "page_twitter": page_twitter, "page_json_ld": page_json_ld, "page_attributes": page_attributes,
    "page_headers": page_headers, "catalog_record": catalog_record,
}


def unescape(expr: str) -> str:
    for entity, char in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


def plain(expr: str) -> str:
    """Text of an HTML fragment."""
    return unescape(f"regexp_replace({expr}, '<[^>]*>', '', 'g')")


def web_clean(expr: str) -> str:
    skipped = "(?i)^(?:" + "|".join(fixed.BOILERPLATE_STARTS) + ")"
    squeezed = sql_strip(f"regexp_replace({expr}, '[{SPACE}]+', ' ', 'g')")
    return f"(CASE WHEN regexp_matches({squeezed}, '{skipped}') THEN '' ELSE {squeezed} END)"


def words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '[^{SPACE}]+'))"


SQL_PAGES = f"""
    pg AS (
      SELECT page_id, url, html, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
        regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
        regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '\\?([^#]*)', 1) AS query,
        {unescape("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS title,
        {plain("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} AS h1,
        regexp_extract(html, '<article>(.*)</article>', 1, 's') AS article
      FROM pages
    ),
    nu AS (
      SELECT *, regexp_replace(lower(host), '^www\\.', '') AS nhost,
        CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS npath FROM pg
    ),
    nm AS (SELECT *, scheme || '://' || nhost || npath || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS normalized FROM nu)"""
SQL_PARAS = f"""
    pieces AS (SELECT page_id, string_split(article, '<p>')[2:] AS ps FROM pg),
    raws AS (
      SELECT page_id, k, CASE WHEN starts_with(ps[k], '<b>') THEN array_to_string(ps[k:], '') ELSE string_split(ps[k], '</p>')[1] END AS frag
      FROM (SELECT page_id, ps, unnest(range(1, len(ps) + 1)) AS k FROM pieces)
    ),
    paras AS (SELECT page_id, k, {sql_strip(plain('frag'))} AS text, {web_clean(plain('frag'))} AS clean FROM raws),
    basic AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, text FROM paras WHERE length(text) > 20),
    rich AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, clean FROM paras
             WHERE length(clean) > 30 AND {words('clean')} >= 5)"""
SQL_LINKS = f"""
    anchors AS (
      SELECT page_id, scheme, host, nhost, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a,
        generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS k FROM nm
    ),
    hrefs AS (
      SELECT page_id, scheme, host, nhost, k, {unescape("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href,
        {unescape("regexp_extract(a, '>([^<]*)<', 1)")} AS text FROM anchors
    )"""
# Tokens of a page, the open elements after each (a stack that an end tag cuts back to its nearest match), and from both the tree.
SQL_TREE = f"""
    cut AS (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<!.*?>|<script>.*?</script>|<style>.*?</style>|</?[a-zA-Z][^>]*>|[^<]+') AS ts FROM pages),
    named AS (SELECT page_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS k FROM cut),
    kinds AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) AS tag, CASE WHEN starts_with(tok, '<!') THEN 'none' WHEN starts_with(tok, '</') THEN 'end'
        WHEN regexp_matches(tok, '^<(script|style|br|meta|img|link|hr|input)\\b') THEN 'leaf' WHEN starts_with(tok, '<') THEN 'start' ELSE 'text' END AS kind FROM named),
    toks AS MATERIALIZED (SELECT *, CASE WHEN kind IN ('start', 'leaf') THEN sum(CASE WHEN kind IN ('start', 'leaf') THEN 1 ELSE 0 END)
        OVER (PARTITION BY page_id ORDER BY k)::BIGINT END AS seq FROM kinds),
    walk AS (
      SELECT page_id, 0::BIGINT AS k, []::BIGINT[] AS seqs, []::VARCHAR[] AS tags FROM pages
      UNION ALL
      SELECT w.page_id, t.k, CASE WHEN kind = 'start' THEN list_append(seqs, t.seq) WHEN kind = 'end' AND list_contains(tags, tag)
          THEN seqs[:len(tags) - list_position(list_reverse(tags), tag)] ELSE seqs END,
        CASE WHEN kind = 'start' THEN list_append(tags, tag) WHEN kind = 'end' AND list_contains(tags, tag)
          THEN tags[:len(tags) - list_position(list_reverse(tags), tag)] ELSE tags END
      FROM walk w JOIN toks t ON t.page_id = w.page_id AND t.k = w.k + 1
    ),
    placed AS MATERIALIZED (SELECT t.*, w.seqs FROM toks t JOIN walk w ON w.page_id = t.page_id AND w.k = t.k - 1),
    texts AS (SELECT page_id, inside, string_agg({unescape("tok")}, '' ORDER BY k) AS text FROM (SELECT page_id, k, tok, unnest(seqs) AS inside FROM placed WHERE kind = 'text') GROUP BY 1, 2),
    lasts AS (SELECT page_id, inside, max(seq) AS last FROM (SELECT page_id, seq, unnest(seqs) AS inside FROM placed WHERE seq IS NOT NULL) GROUP BY 1, 2),
    tree AS (SELECT p.page_id, p.seq, coalesce(l.last, p.seq) AS last, len(p.seqs)::BIGINT AS level, coalesce(p.seqs[-1], 0) AS container, p.tag, text
        FROM placed p LEFT JOIN texts x ON x.page_id = p.page_id AND x.inside = p.seq LEFT JOIN lasts l ON l.page_id = p.page_id AND l.inside = p.seq WHERE p.seq IS NOT NULL)"""
SQL_PART = "SELECT p_partkey AS page_id"
TWO = "https://vendor"


def per_part(*rows: str) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey AS page_id, {row} FROM part" for row in rows)


def metas(*pairs: tuple[str, str]) -> str:
    return per_part(*[f"'{k}' AS key, {v} AS value" for k, v in pairs])


COMMON_METAS = [
    ("description", "p_type || ' item'"), ("keywords", "p_brand"), ("og:title", "p_name"), ("og:type", "'product'"),
    ("twitter:card", "'summary'"), ("twitter:site", "p_brand"), ("viewport", "'width=device-width'"), ("robots", "'index'"),
]
DIR = "regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]+$', '')"
ORIGIN = "scheme || '://' || host"
RESOLVED = [
    f"{ORIGIN} || {DIR} || 'x/y'", f"{ORIGIN} || regexp_replace({DIR}, '[^/]+/$', '') || 'z'", f"{ORIGIN} || {DIR} || 'w/'",
    f"{ORIGIN} || path || '?q=1'", "scheme || '://other.example/k'", f"{ORIGIN} || '/abs/b'",
    f"{ORIGIN} || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END || '#frag'", "'mailto:a@b.c'",
    # a different scheme is answered as written, the same one in its lower-case form
    "CASE WHEN scheme = 'http' THEN 'http://Q.example/u' ELSE 'HTTP://Q.example/u' END",
]

ORACLES = {
    "url_normalize": f"WITH {SQL_PAGES} SELECT page_id, normalized FROM nm",
    "url_normalize_bare": f"WITH {SQL_PAGES} SELECT page_id, 'https://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS normalized FROM pg",
    "url_valid": f"WITH {SQL_PAGES} SELECT page_id, scheme IN ('http', 'https') AND host <> '' AS valid, nhost = 'cheap-pills.example.com' AS on_domain, false AS bare_valid FROM nm",
    "url_exclude": """SELECT page_id, regexp_matches(url || ['', '.pdf', '.PNG', '.tar.gz', '.html', '.mp3', '.docx'][page_id % 7 + 1],
        '(?i)(\\.(pdf|docx?|xlsx?|pptx?|zip|rar|tar\\.gz|exe|dmg|mp[34]|avi|mov|wmv|flv|jpe?g|png|gif|bmp|svg)$|mailto:|tel:|ftp:|javascript:)') AS excluded FROM pages""",
    "url_parts": f"WITH {SQL_PAGES} SELECT page_id, nhost AS domain, npath AS path FROM nm",
    "url_resolve": f"WITH {SQL_PAGES} " + " UNION ALL ".join(
        f"SELECT page_id, '{href}' AS href, {expected} AS resolved FROM nm" for href, expected in zip(HREFS, RESOLVED)
    ),
    "url_default_scheme": """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS full FROM pages""",
    "page_elements": f"WITH RECURSIVE {SQL_TREE} SELECT page_id, seq, last, level, container, tag, md5(coalesce(text, '')) AS text_md5 FROM tree",
    "page_title": f"""WITH {SQL_PAGES} SELECT page_id, {sql_strip('title')} AS title,
        CASE WHEN {web_clean('title')} <> '' THEN {web_clean('title')} ELSE {web_clean('h1')} END AS clean_title FROM pg""",
    "page_headings": f"WITH {SQL_PAGES} SELECT page_id, 0::BIGINT AS pos, {sql_strip('h1')} AS heading FROM pg",
    "page_headings_enhanced": f"WITH {SQL_PAGES} SELECT page_id, 1::BIGINT AS level, {web_clean('h1')} AS text FROM pg WHERE {words(web_clean('h1'))} >= 2",
    "page_paragraphs": f"WITH {SQL_PAGES}, {SQL_PARAS} SELECT page_id, pos, text AS paragraph FROM basic",
    "page_paragraphs_enhanced": f"WITH {SQL_PAGES}, {SQL_PARAS} SELECT page_id, pos, clean AS paragraph FROM rich",
    "page_links": f"""WITH {SQL_PAGES}, {SQL_LINKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos,
        scheme || '://' || host || href AS url, {sql_strip('text')} AS text FROM hrefs WHERE starts_with(href, '/') AND {sql_strip('text')} <> ''""",
    "page_links_enhanced": f"""WITH {SQL_PAGES}, {SQL_LINKS},
        full_ AS (SELECT page_id, k, text, scheme || '://' || nhost || CASE WHEN rtrim(href, '/') = '' THEN '/' ELSE rtrim(href, '/') END AS url FROM hrefs),
        once AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY k) AS nth FROM full_ QUALIFY nth = 1)
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, url, {web_clean('text')} AS text, 'internal' AS type FROM once""",
    "page_lists": f"""WITH i AS (SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1),
          lambda v: {web_clean(plain('v'))}), lambda v: v <> '')) AS text,
          generate_subscripts(list_filter(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1),
          lambda v: {web_clean(plain('v'))}), lambda v: v <> ''), 1) - 1 AS pos FROM pages)
        SELECT page_id, 'ul' AS type, CAST(pos AS BIGINT) AS pos, text FROM i""",
    "page_main_content": f"""WITH {SQL_PAGES}, {SQL_PARAS}, m AS (SELECT page_id, {web_clean(plain('article'))} AS text FROM pg),
        fb AS (SELECT page_id, string_agg(clean, ' ' ORDER BY pos) AS text FROM rich WHERE pos < 5 GROUP BY page_id),
        x AS (SELECT page_id, CASE WHEN m.text <> '' THEN m.text ELSE coalesce(fb.text, '') END AS text FROM m LEFT JOIN fb USING (page_id))
        SELECT page_id, text AS main_content, CAST(length(text) AS BIGINT) AS text_length FROM x""",
    "page_quality": f"""WITH {SQL_PAGES}, {SQL_PARAS}, m AS (SELECT page_id, html, title, h1, {web_clean(plain('article'))} AS text FROM pg),
        n AS (SELECT page_id, count(*) AS np FROM rich GROUP BY page_id),
        x AS (SELECT m.page_id, length({web_clean('title')}) AS tl, length(text) AS n, length(html) AS h, coalesce(np, 0) AS np,
                {words(web_clean('h1'))} >= 2 AS hs FROM m LEFT JOIN n USING (page_id))
        SELECT page_id, {r('''least(1.0::DOUBLE, CASE WHEN tl > 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n > 500 THEN 0.3::DOUBLE WHEN n > 200 THEN 0.2 WHEN n > 100 THEN 0.1 ELSE 0 END
          + CASE WHEN hs THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN np > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN np > 3 THEN 0.1::DOUBLE ELSE 0 END
          + CASE WHEN n::DOUBLE / h > 0.1 THEN 0.1::DOUBLE WHEN n::DOUBLE / h > 0.05 THEN 0.05 ELSE 0 END)''')} AS quality_score FROM x""",
    "page_counts": f"""WITH {SQL_PAGES}, {SQL_PARAS}, n AS (SELECT page_id, count(*) AS np FROM basic GROUP BY page_id)
        SELECT page_id, CAST(length(html) AS BIGINT) AS content_length, 1::BIGINT AS headings_count, coalesce(np, 0) AS paragraphs_count,
          0::BIGINT AS links_count, 0::BIGINT AS images_count, coalesce(np, 0) AS paragraphs_kept FROM pg LEFT JOIN n USING (page_id)""",
    "page_caps": f"""WITH {SQL_PAGES}, {SQL_PARAS}, {SQL_LINKS}, n AS (SELECT page_id, count(*) AS np FROM basic GROUP BY page_id),
        k AS (SELECT page_id, count(*) FILTER (WHERE starts_with(href, '/') AND {sql_strip('text')} <> '') AS nl FROM hrefs GROUP BY page_id)
        SELECT page_id, coalesce(nl, 0) AS links_count, coalesce(np, 0) AS paragraphs_count, least(30, coalesce(nl, 0)) AS links_kept,
          least(15, coalesce(np, 0)) AS paragraphs_kept FROM pg LEFT JOIN n USING (page_id) LEFT JOIN k USING (page_id)""",
    "page_lang": "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages",
    "text_clean_web": f"SELECT doc_id, {web_clean('text')} AS cleaned FROM documents",
    "page_tables": per_part("0::BIGINT AS table_no, 0::BIGINT AS row_no, 'Brand|' || p_brand AS cells", "0::BIGINT AS table_no, 1::BIGINT AS row_no, 'Size ' || p_size || '|' AS cells"),
    "page_nested_lists": per_part("0::BIGINT AS pos, 'ul' AS type, p_type || 'size ' || p_size || '|size ' || p_size AS items", "1::BIGINT AS pos, 'ol' AS type, 'size ' || p_size AS items"),
    "page_images": per_part(
        "0::BIGINT AS pos, 'https://shop.example/items/img/' || p_partkey || '.jpg' AS src, p_name AS alt, '' AS title, CAST(p_size AS VARCHAR) AS width, NULL::VARCHAR AS height, 'eager' AS loading",
        "1::BIGINT AS pos, 'https://shop.example/abs.png' AS src, '' AS alt, '' AS title, NULL::VARCHAR AS width, NULL::VARCHAR AS height, 'lazy' AS loading",
    ),
    "page_videos": per_part("'https://shop.example/items/v/' || p_partkey || '.mp4' AS src, 'video/mp4' AS type, '/p.png' AS poster, true AS controls, false AS autoplay"),
    "page_meta": metas(*COMMON_METAS, ("content-type", "'text/html; charset=iso-8859-1'")),
    "page_meta_basic": metas(*COMMON_METAS, ("Keywords", "'first'")),
    "page_open_graph": metas(("title", "p_name"), ("type", "'product'")),
    "page_twitter": metas(("card", "'summary'"), ("site", "p_brand")),
    "page_json_ld": per_part("p_partkey AS sku, CAST(p_size AS BIGINT) AS size"),
    "page_attributes": per_part("""'https://shop.example/p/' || p_partkey AS canonical_url, 'https://www.Shop.example/icons/' || p_size || '.ico' AS favicon,
        'en' AS language, 'iso-8859-1' AS charset, 'width=device-width' AS viewport, 'index' AS robots"""),
    "page_headers": per_part("'text/html' AS content_type, p_brand AS server, '' AS last_modified, '' AS cache_control, '' AS etag, '' AS content_encoding"),
    "catalog_record": per_part("""'https://shop.example/items/' || p_partkey || '.html' AS url, p_name AS title,
        p_name || ' by ' || p_brand || '|Offer ' || p_brand AS headings,
        'https://shop.example/list?page=' || p_size || ' https://vendor' || p_size || '.example/a mailto:x@shop.example' AS link_urls,
        'https://shop.example/items/img/' || p_partkey || '.jpg https://shop.example/abs.png' AS image_urls,
        2::BIGINT AS headings_count, 1::BIGINT AS paragraphs_count, 3::BIGINT AS links_count, 2::BIGINT AS images_count"""),
}
