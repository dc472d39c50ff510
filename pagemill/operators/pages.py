"""Page records from element arrays.

A page's elements travel in one row, so every rule is an array expression and the
whole extraction is a map over the corpus. Rules on texts need the page's text pieces beside ``elements``. ``profile`` selects the rule set:

* ``basic``     level-ordered headings, absolute links only
* ``api``       document order, link text required, extended metadata
* ``crawl``     as ``api``
* ``enhanced``  boilerplate removed, cleaned and filtered text, normalised links
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagemill import fixed_values as fixed
from pagemill.functions import urls
from pagemill.functions.common import SPACE, let, squeeze, strip, word_count
from pagemill.operators.elements import JSON_LD, TEXTS, body_of, part_of, text_of, with_elements

PROFILES = ("basic", "api", "crawl", "enhanced")
# Response limits per profile, for callers that want them: headings, paragraphs, links, images kept per page.
CAPS = {"basic": (20, 50, 100, 50), "api": (20, 20, 50, 20), "crawl": (15, 15, 30, 15)}
CONTENT_CAP, LINK_TEXT_CAP = 1000, 100  # characters of main content (enhanced) and of a link's text (basic)
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
TEXTS = "array<string>"


def clean_web_text(text: Column) -> Column:
    """Single spaces; empty when the text starts like navigation or a footer."""
    # (?U) makes \w, \s and \b Unicode-aware; (?s) lets the rest of the text follow.
    skipped = "(?iU)^(?:" + "|".join(fixed.BOILERPLATE_STARTS) + ")"
    clean = squeeze(F.coalesce(text, F.lit("")))
    return let(clean, lambda t: F.when(t.rlike(skipped), F.lit("")).otherwise(t))


def _tagged(elements: Column, *tags: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*tags))


def _attr(element: Column, name: str, default: str | None = "") -> Column:
    value = element["attrs"][name]
    return value if default is None else F.coalesce(value, F.lit(default))


def _body(element: Column) -> Column:
    return F.coalesce(body_of(element), F.lit(""))


def _cut(text: Column, cap: int | None) -> Column:
    return text if cap is None else F.substring(text, 1, cap)


def _first(elements: Column) -> Column:
    return F.get(elements, F.lit(0))


def body_elements(elements: Column) -> Column:
    """Elements outside scripts, styles, navigation, headers and footers."""
    return F.filter(elements, lambda e: ~e["boilerplate"])


def title(elements: Column, profile: str) -> Column:
    found = _first(_tagged(elements, "title"))
    if profile == "enhanced":
        own = clean_web_text(text_of(found))
        heading = clean_web_text(text_of(_first(_tagged(elements, "h1"))))
        return F.when(own != "", own).otherwise(heading)
    missing = "No title" if profile == "basic" else "No title found"
    return F.coalesce(strip(text_of(found)), F.lit(missing))


def headings(elements: Column, profile: str) -> Column:
    """Texts in profile order; the enhanced profile keeps level and tag."""
    found = _tagged(elements, *HEADINGS)
    if profile == "enhanced":
        rows = F.transform(
            found,
            lambda e: F.struct(
                F.substring(e["tag"], 2, 1).cast("int").alias("level"), e["seq"].alias("seq"),
                clean_web_text(_body(e)).alias("text"), e["tag"].alias("tag"),
            ),
        )
        kept = F.filter(rows, lambda h: (h["text"] != "") & (word_count(h["text"]) >= 2))
        return F.transform(
            F.sort_array(kept), lambda h: F.struct(h["level"].alias("level"), h["text"].alias("text"), h["tag"].alias("tag"))
        )
    if profile == "basic":
        rows = F.transform(found, lambda e: F.struct(e["tag"], e["seq"], strip(text_of(e)).alias("text")))
        return F.transform(F.sort_array(rows), lambda h: h["text"])
    return F.filter(F.transform(found, lambda e: strip(text_of(e))), lambda t: F.length(t) > 2)


def _kept_paragraphs(elements: Column, profile: str) -> Column:
    """Elements of the paragraphs that the profile keeps, decided by their measures alone: linear in the page."""
    found = _tagged(elements, "p")
    if profile != "enhanced":
        return F.filter(found, lambda e: e["measure"]["chars"] > 20)
    measure = lambda e: F.coalesce(e["body_measure"], e["measure"])
    # Every start that drops a text is shorter than the measured head, and the one that asks for the text's end fails its length.
    return F.filter(found, lambda e: (measure(e)["squeezed"] > 30) & (measure(e)["words"] >= 5) & (clean_web_text(measure(e)["head"]) != ""))


def _paragraph_text(element: Column, profile: str) -> Column:
    return clean_web_text(_body(element)) if profile == "enhanced" else strip(text_of(element))


def paragraphs(elements: Column, profile: str, first: int | None = None) -> Column:
    """Paragraph texts, the ``first`` ones if given; an unclosed paragraph repeats the ones inside it."""
    kept = _kept_paragraphs(elements, profile)
    return F.transform(kept if first is None else F.slice(kept, 1, first), lambda e: _paragraph_text(e, profile))


def paragraph_spans(elements: Column, profile: str, longest: int = 0) -> Column:
    """Paragraphs without repeating text: struct(``seq``, ``chars``, ``words``, ``start``, ``end``, ``text``).

    ``start`` and ``end`` are piece numbers of ``body_pieces`` (enhanced, outside boilerplate) or ``text_pieces``. The text is
    written out up to ``longest`` characters, and null beyond, so nested paragraphs cost no more than that each.
    """

    def span(e: Column) -> Column:
        own = profile == "enhanced"
        measure = F.coalesce(e["body_measure"], e["measure"]) if own else e["measure"]
        pieces = F.coalesce(e["body"], e["text"]) if own else e["text"]
        chars = measure["squeezed" if own else "chars"]
        return F.struct(
            e["seq"].alias("seq"), chars.alias("chars"), measure["words"].alias("words"), pieces["start"].alias("start"),
            (pieces["start"] + pieces["size"]).alias("end"), F.when(chars <= longest, _paragraph_text(e, profile)).alias("text"),
        )

    return F.transform(_kept_paragraphs(elements, profile), span)


def lists(elements: Column) -> Column:
    blocks = F.transform(
        _tagged(elements, "ul", "ol"),
        lambda e: F.struct(
            e["tag"].alias("type"),
            F.filter(F.transform(e["parts"], lambda p: clean_web_text(part_of(p))), lambda item: item != "").alias("items"),
        ),
    )
    return F.filter(blocks, lambda b: F.size(b["items"]) > 0)


def _held(holder: Column, items: Column, whole: bool) -> Column:
    """The rows of a table, or the sources of a video: a range of the page's, found while the page was read."""
    return F.slice(items, holder["held" if whole else "body_held"]["start"] + 1, holder["held" if whole else "body_held"]["size"])


def tables(elements: Column, whole: bool = True) -> Column:
    """Rows of cleaned cells per table; empty cells stay, empty rows and tables go. ``whole``: boilerplate is among ``elements``."""

    def block(table: Column, rows: Column) -> Column:
        own = F.filter(_held(table, rows, whole), lambda row: F.size(row["parts"]) > 0)
        return F.struct(F.transform(own, lambda row: F.transform(row["parts"], lambda p: clean_web_text(part_of(p)))).alias("rows"))

    found = _tagged(elements, "table")
    blocks = let(_tagged(elements, "tr"), lambda rows: F.transform(found, lambda table: block(table, rows)))
    return F.filter(blocks, lambda t: F.size(t["rows"]) > 0)


def main_content(elements: Column, paras: Column) -> Column:
    """Text of the best-ranked content element, else the first five paragraphs of ``paras``."""

    def rank(e: Column, classes: Column) -> Column:
        best = F.lit(None).cast("int")
        for place, selector in reversed(list(enumerate(fixed.MAIN_SELECTORS))):
            if selector.startswith("."):
                matches = F.array_contains(classes, selector[1:])
            elif selector.startswith("#"):
                matches = _attr(e, "id") == selector[1:]
            else:
                matches = e["tag"] == selector
            best = F.when(matches, place).otherwise(best)
        return best

    tags = [selector for selector in fixed.MAIN_SELECTORS if selector[0] not in ".#"]
    named = F.filter(elements, lambda e: e["tag"].isin(*tags) | _attr(e, "class", None).isNotNull() | _attr(e, "id", None).isNotNull())
    classed = lambda e: let(F.split(_attr(e, "class"), rf"[{SPACE}]+"), lambda classes: rank(e, classes))
    ranked = F.transform(named, lambda e: F.struct(classed(e).alias("rank"), e["seq"].alias("seq"), e["text"].alias("text"), e["body"].alias("body")))
    best = F.array_min(F.filter(ranked, lambda e: e["rank"].isNotNull()))
    fallback = F.array_join(F.slice(paras, 1, 5), " ")
    return let(clean_web_text(_body(best)), lambda text: F.when(text != "", text).otherwise(fallback))


def _first_by_url(rows: Column) -> Column:
    """Rows whose ``url`` has not occurred before, in order: sort, keep run starts, sort back."""
    placed = F.sort_array(
        F.transform(rows, lambda row, at: F.struct(row["url"].alias("url"), at.alias("at"), row.alias("row")))
    )

    def run_starts(sorted_rows: Column) -> Column:
        return F.filter(sorted_rows, lambda s, i: (i == 0) | (F.get(sorted_rows, i - 1)["url"] != s["url"]))

    kept = F.transform(let(placed, run_starts), lambda s: F.struct(s["at"].alias("at"), s["row"].alias("row")))
    return F.transform(F.sort_array(kept), lambda s: s["row"])


def links(elements: Column, base: Column, profile: str, text_cap: int | None = None) -> Column:
    found = F.filter(_tagged(elements, "a"), lambda e: _attr(e, "href") != "")
    if profile == "basic":
        absolute = F.filter(found, lambda e: F.startswith(_attr(e, "href"), F.lit("http")))
        return F.transform(
            absolute,
            lambda e: F.struct(_attr(e, "href").alias("url"), _cut(strip(text_of(e)), text_cap).alias("text")),
        )
    if profile == "enhanced":
        # "#..." and blank references lead nowhere
        usable = F.filter(found, lambda e: ~strip(_attr(e, "href")).rlike("^(#|$)"))

        def describe(e: Column, page: Column, parts: Column) -> Column:
            rel = F.filter(F.split(_attr(e, "rel"), rf"[{SPACE}]+"), lambda r: r != "")
            return let(
                urls.normalize_url(let(strip(_attr(e, "href")), lambda href: urls.resolve_url(page, href, parts))),
                lambda url: F.struct(
                    url.alias("url"), clean_web_text(_body(e)).alias("text"), _attr(e, "title").alias("title"),
                    urls.link_type(url, page, parts).alias("type"), rel.alias("rel"),
                ),
            )

        return _first_by_url(urls.with_parts(base, lambda page, parts: F.transform(usable, lambda e: describe(e, page, parts))))

    def target(e: Column, page: Column, parts: Column) -> Column:
        href = strip(_attr(e, "href"))
        return let(
            href,
            lambda h: F.struct(
                F.when(F.startswith(h, F.lit("/")), urls.resolve_url(page, h, parts)).when(h.rlike("^https?://"), h).alias("url"),
                strip(text_of(e)).alias("text"),
            ),
        )

    targets = urls.with_parts(base, lambda page, parts: F.transform(found, lambda e: target(e, page, parts)))
    return F.filter(targets, lambda link: link["url"].isNotNull() & (link["text"] != ""))


def images(elements: Column, base: Column, profile: str) -> Column:
    found = _tagged(elements, "img")
    stripped = profile != "basic"
    sources = lambda e: strip(_attr(e, "src")) if stripped else _attr(e, "src")
    used = F.filter(found, lambda e: sources(e) != "")

    def describe(e: Column, page: Column, parts: Column) -> Column:
        absolute = lambda src: urls.resolve_url(page, src, parts)
        if profile in ("basic", "enhanced"):
            fields = [let(sources(e), absolute).alias("src"), _attr(e, "alt").alias("alt"), _attr(e, "title").alias("title")]
            if profile == "enhanced":
                fields += [
                    _attr(e, "width", None).alias("width"), _attr(e, "height", None).alias("height"),
                    _attr(e, "loading", "eager").alias("loading"),
                ]
            return F.struct(*fields)
        source = let(sources(e), lambda src: F.when(F.startswith(src, F.lit("/")), absolute(src)).otherwise(src))
        return F.struct(source.alias("src"), strip(_attr(e, "alt")).alias("alt"))

    return urls.with_parts(base, lambda page, parts: F.transform(used, lambda e: describe(e, page, parts)))


def videos(elements: Column, base: Column, whole: bool = True) -> Column:
    """Videos with sources that lead somewhere. ``whole``: boilerplate is among ``elements``."""

    def describe(video: Column, sources: Column, page: Column, parts: Column) -> Column:
        own = F.filter(_held(video, sources, whole), lambda s: strip(_attr(s, "src")) != "")
        return F.struct(
            F.transform(
                own,
                lambda s: F.struct(
                    let(strip(_attr(s, "src")), lambda src: urls.resolve_url(page, src, parts)).alias("src"), _attr(s, "type").alias("type")
                ),
            ).alias("sources"),
            _attr(video, "poster").alias("poster"),
            _attr(video, "controls", None).isNotNull().alias("controls"),
            _attr(video, "autoplay", None).isNotNull().alias("autoplay"),
        )

    found = _tagged(elements, "video")
    described = urls.with_parts(
        base,
        lambda page, parts: let(_tagged(elements, "source"), lambda sources: F.transform(found, lambda v: describe(v, sources, page, parts))),
    )
    return F.filter(described, lambda v: F.size(v["sources"]) > 0)


def _last_by_key(entries: Column) -> Column:
    """Map of (key, value) entries in order of first occurrence, where the last entry of a key wins: sort once, keep run ends."""
    placed = F.sort_array(F.transform(entries, lambda e, at: F.struct(e["key"].alias("key"), at.alias("at"), e["value"].alias("value"))))

    def runs(rows: Column) -> Column:
        starts = F.filter(rows, lambda e, i: (i == 0) | (F.get(rows, i - 1)["key"] != e["key"]))
        ends = F.filter(rows, lambda e, i: (i == F.size(rows) - 1) | (F.get(rows, i + 1)["key"] != e["key"]))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s["at"].alias("at"), s["key"].alias("key"), e["value"].alias("value")))

    return F.map_from_entries(F.transform(F.sort_array(let(placed, runs)), lambda e: F.struct(e["key"], e["value"])))


def _meta_entries(elements: Column, key, stripped: bool) -> Column:
    content = (lambda e: strip(_attr(e, "content"))) if stripped else (lambda e: _attr(e, "content"))
    used = F.filter(_tagged(elements, "meta"), lambda e: (F.coalesce(key(e), F.lit("")) != "") & (_attr(e, "content") != ""))
    return F.transform(used, lambda e: F.struct(key(e).alias("key"), content(e).alias("value")))


def meta(elements: Column, profile: str) -> Column:
    names = ["name", "property"] if profile == "basic" else ["name", "property", "http-equiv"]

    def key(e: Column) -> Column:
        found = F.coalesce(*[F.nullif(_attr(e, name, None), F.lit("")) for name in names])
        return found if profile == "basic" else F.lower(found)

    return _last_by_key(_meta_entries(elements, key, stripped=profile in ("api", "crawl")))


def _prefixed(elements: Column, attribute: str, prefix: str, profile: str) -> Column:
    key = lambda e: F.regexp_extract(_attr(e, attribute), "(?s)^" + prefix + "(.+)$", 1)
    return _last_by_key(_meta_entries(elements, key, stripped=profile in ("api", "crawl")))


def open_graph(elements: Column, profile: str) -> Column:
    return _prefixed(elements, "property", "og:", profile)


def twitter_card(elements: Column, profile: str) -> Column:
    return _prefixed(elements, "name", "twitter:", profile)


def json_ld(elements: Column) -> Column:
    """Parsed JSON-LD blocks; invalid ones are dropped. Read from the whole page."""
    blocks = F.filter(_tagged(elements, "script"), lambda e: _attr(e, "type") == JSON_LD)
    return F.filter(F.transform(blocks, lambda e: F.try_parse_json(e["data"])), lambda v: v.isNotNull())


def document_attributes(elements: Column, base: Column) -> Column:
    """struct(canonical_url, favicon, language, charset, viewport, robots); null where absent."""
    linked = _tagged(elements, "link")
    rels = lambda e: F.split(strip(_attr(e, "rel")), rf"[{SPACE}]+")
    canonical = _first(F.filter(linked, lambda e: F.array_contains(rels(e), "canonical")))
    icon = _first(F.filter(linked, lambda e: F.array_contains(rels(e), "icon")))
    metas = _tagged(elements, "meta")
    named = lambda name: _first(F.filter(metas, lambda e: _attr(e, "name") == name))
    typed = _first(F.filter(metas, lambda e: _attr(e, "http-equiv") == "Content-Type"))
    declared = _first(F.filter(metas, lambda e: _attr(e, "charset", None).isNotNull()))
    from_type = F.regexp_extract(_attr(typed, "content"), "charset=(.*?)(?:charset=|$)", 1)
    favicon = let(
        strip(_attr(icon, "href")),
        lambda href: F.when(F.startswith(href, F.lit("/")), urls.resolve_url(base, href)).otherwise(href),
    )
    has_charset = F.contains(_attr(typed, "content"), F.lit("charset="))
    return F.struct(
        F.when(canonical.isNotNull(), strip(_attr(canonical, "href"))).alias("canonical_url"),
        F.when(icon.isNotNull(), favicon).alias("favicon"),
        F.nullif(strip(_attr(_first(_tagged(elements, "html")), "lang")), F.lit("")).alias("language"),
        F.when(declared.isNotNull(), strip(_attr(declared, "charset"))).when(has_charset, strip(from_type)).alias("charset"),
        F.when(named("viewport").isNotNull(), strip(_attr(named("viewport"), "content"))).alias("viewport"),
        F.when(named("robots").isNotNull(), strip(_attr(named("robots"), "content"))).alias("robots"),
    )


def response_headers(headers: Column) -> Column:
    """Six named response headers, '' where absent."""
    names = ["content-type", "server", "last-modified", "cache-control", "etag", "content-encoding"]
    return F.struct(*[F.coalesce(headers[name], F.lit("")).alias(name.replace("-", "_")) for name in names])


def quality_score(title_: Column, text_length: Column, n_headings: Column, n_paras: Column, html_length: Column) -> Column:
    """Content quality between 0 and 1."""
    ratio = text_length / F.nullif(html_length, F.lit(0))
    points = [
        F.when(F.length(title_) > 10, 0.2).otherwise(0.0),
        F.when(text_length > 500, 0.3).when(text_length > 200, 0.2).when(text_length > 100, 0.1).otherwise(0.0),
        F.when(n_headings > 0, 0.2).otherwise(0.0),
        F.when(n_paras > 0, 0.2).otherwise(0.0),
        F.when(n_paras > 3, 0.1).otherwise(0.0),
        F.when(ratio > 0.1, 0.1).when(ratio > 0.05, 0.05).otherwise(0.0),
    ]
    total = points[0]
    for point in points[1:]:
        total = total + point
    return F.least(F.lit(1.0), total)


def extract(
    pages: DataFrame,
    profile: str = "enhanced",
    drop_boilerplate: bool | None = None,
    as_of: Column | None = None,
    caps: tuple[int, int, int, int] | None = None,
    text_cap: int | None = None,
) -> DataFrame:
    """Page records of a (.., url, html) corpus under one profile.

    Records are whole. ``caps`` (such as ``CAPS[profile]``) limits the headings, paragraphs, links and images
    of a record, and ``text_cap`` the characters of main content (enhanced) or of a link's text (basic); counts
    and scores are those of the whole page either way. ``drop_boilerplate`` defaults to the profile's rule. Optional columns
    ``headers`` (map), ``status_code`` are used when present; other columns pass through.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    enhanced = profile == "enhanced"
    drop = enhanced if drop_boilerplate is None else drop_boilerplate
    parsed = with_elements(pages)
    every = F.col("elements")
    if drop:
        parsed = parsed.withColumn("_body", body_elements(every))
    body = F.col("_body") if drop else every
    base = urls.normalize_url(F.col("url")) if enhanced else F.col("url")
    parsed = parsed.withColumn("_base", base)
    base = F.col("_base")
    columns = {
        "title": title(every, profile),
        "headings": headings(body, profile),
        "paragraphs": paragraphs(body, profile),
        "links": links(body, base, profile, text_cap),
        "images": images(body, base, profile),
        "meta": meta(every, profile),
    }
    if profile != "basic":
        columns["open_graph"] = open_graph(every, profile)
        columns["twitter"] = twitter_card(every, profile)
        columns["json_ld"] = json_ld(every)
    if profile in ("api", "crawl"):
        columns["attributes"] = document_attributes(every, base)
    if profile != "basic" and "headers" in pages.columns:
        columns["http_headers"] = response_headers(F.col("headers"))
        if enhanced:
            columns["content_type"] = columns["http_headers"]["content_type"]
            columns["last_modified"] = columns["http_headers"]["last_modified"]
    if enhanced:
        columns["videos"] = videos(body, base, whole=not drop)
        columns["lists"] = lists(body)
        columns["tables"] = tables(body, whole=not drop)
    out = parsed.withColumns(columns)
    if enhanced:
        out = out.withColumn("main_content", main_content(body, paragraphs(body, profile, first=5)))
    out = out.withColumn("paragraphs_count", F.size(_kept_paragraphs(body, profile)).cast("long"))
    out = _counted(out, profile, as_of, caps, text_cap).drop("elements", *TEXTS, "_body", "headers")
    return out.drop("_base")


def _counted(
    df: DataFrame, profile: str, as_of: Column | None, caps: tuple[int, int, int, int] | None, text_cap: int | None
) -> DataFrame:
    sized = ["headings", "paragraphs", "links", "images"]
    if profile == "enhanced":
        sized += ["videos", "lists", "tables"]
    counts = {f"{name}_count": F.size(name).cast("long") for name in sized if name != "paragraphs"}  # those are counted without their texts
    counts["scraped_at"] = as_of if as_of is not None else F.current_timestamp()
    if profile == "enhanced":
        counts["text_length"] = F.length("main_content").cast("long")
        counts["original_url"] = F.col("url")
    kept = {c: F.slice(c, 1, cap) for c, cap in zip(sized, caps)} if caps else {}
    out = df.withColumns(counts)
    if profile != "enhanced":
        return out.withColumns(kept)
    score = quality_score(
        F.col("title"), F.col("text_length"), F.col("headings_count"), F.col("paragraphs_count"), F.col("content_length")
    )
    return out.withColumns(
        {
            "url": F.col("_base"),
            "domain": urls.domain(F.col("_base")),
            "path": urls.path(F.col("_base")),
            "quality_score": score,
            "main_content": _cut(F.col("main_content"), text_cap),
            **kept,
        }
    )


def common_shape(enhanced: DataFrame) -> DataFrame:
    """Enhanced records in the shape the other profiles share."""
    keys = [c for c in ("page_id",) if c in enhanced.columns]
    return enhanced.select(
        *keys, "url", "title",
        F.transform("headings", lambda h: h["text"]).alias("headings"),
        "paragraphs",
        F.transform("links", lambda k: F.struct(k["url"].alias("url"), k["text"].alias("text"))).alias("links"),
        F.transform(
            "images", lambda i: F.struct(i["src"].alias("src"), i["alt"].alias("alt"), i["title"].alias("title"))
        ).alias("images"),
        "meta", "content_length", "headings_count", "paragraphs_count", "links_count", "images_count", "scraped_at",
    )
