"""Crawl-graph traversal and crawl outcomes as joins over page and link tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill import fixed_values as fixed
from pagemill.functions import urls
from pagemill.plans.skew import join_on_hot_key
from pagemill.plans.stored import materialize


LINKS_OF_A_TASK = 50_000  # links of one page that are followed in one task


def split_adjacency(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with the ``block`` they lie in, hubs with their number of ``blocks``).

    A page with more than ``LINKS_OF_A_TASK`` links is cut into blocks by a hash of the target; every other page is one block, and without any
    hub links have none. There are at most as many hubs as full blocks.
    """
    edges = links.select("src", "dst")
    degrees = edges.groupBy("src").agg(F.count("*").alias("degree")).filter(F.col("degree") > LINKS_OF_A_TASK)
    hubs = materialize(degrees.select("src", F.ceil(F.col("degree") / LINKS_OF_A_TASK).cast("int").alias("blocks")), "hubs")
    if hubs.isEmpty():
        return edges, hubs
    blocks = F.coalesce("blocks", F.lit(1))
    placed = edges.join(hubs, "src", "left").select("src", "dst", F.pmod(F.xxhash64("dst"), blocks).cast("int").alias("block"))
    return materialize(placed, "blocks"), hubs


def breadth_first(
    links: DataFrame,
    seeds: DataFrame,
    depth: int,
    max_pages: int,
    pages: DataFrame | None = None,
    same_prefix: bool = False,
) -> DataFrame:
    """Level-by-level crawl of many seeds at once: (crawl_id, url, level).

    ``links`` has (src, dst), ``seeds`` (crawl_id, url). A crawl stops before the level
    at which it already has ``max_pages`` pages; a level is never cut. ``pages`` (url)
    limits it to stored pages; ``same_prefix`` to URLs that start with the seed URL.
    The driver only loops over levels; each level is stored, so lineage stays flat. Pages with very many links are followed
    block by block, and pages per crawl are added up from one count per crawl and level.
    """
    if depth < 1 or max_pages < 1:
        raise ValueError("depth and max_pages must be at least 1")
    roots = seeds.select("crawl_id", F.col("url").alias("_base"))
    edges, hubs = split_adjacency(links) if depth > 1 else (None, None)
    hubs = None if hubs is None or hubs.isEmpty() else hubs
    frontier = seeds.select("crawl_id", "url").distinct()
    levels: list[DataFrame] = []
    counts: list[DataFrame] = []
    for level in range(depth):
        if pages is not None:
            frontier = frontier.join(pages.select("url"), "url", "left_semi")
        stored = materialize(frontier.select("crawl_id", "url", F.lit(level).alias("level")), "level")
        levels.append(stored)
        if level == depth - 1 or stored.isEmpty():
            break
        counts.append(stored.groupBy("crawl_id").agg(F.count("*").alias("_n")))
        totals = reduce(DataFrame.unionByName, counts).groupBy("crawl_id").agg(F.sum("_n").alias("_n"))
        sources = stored.join(totals.filter(F.col("_n") < max_pages).select("crawl_id"), "crawl_id", "left_semi")
        blocks = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        spread = sources.withColumnRenamed("url", "src")
        if hubs is not None:
            spread = spread.join(hubs, "src", "left").select("crawl_id", "src", F.explode(blocks).alias("block"))
        reached = spread.join(edges, ["src", "block"] if hubs is not None else ["src"]).select("crawl_id", F.col("dst").alias("url"))
        if same_prefix:
            reached = reached.join(roots, "crawl_id").filter(F.expr("startswith(url, _base)")).drop("_base")
        visited = reduce(DataFrame.unionByName, levels).select("crawl_id", "url")
        frontier = reached.distinct().join(visited, ["crawl_id", "url"], "left_anti")
    return reduce(DataFrame.unionByName, levels)


def bounded_crawl(links: DataFrame, seeds: DataFrame, max_pages: int, depth: int = 2) -> DataFrame:
    """First-in-first-out crawl with a strict page bound: (crawl_id, position, url).

    Only the seed page is expanded: its own-host links in page order, each once.
    ``links`` has (src, link_seq, dst).
    """
    first = seeds.select("crawl_id", F.lit(0).alias("position"), "url")
    if depth < 2 or max_pages < 2:
        return first
    # A page stored several times has its links once, so a join makes no row per copy and link.
    own = links.filter((F.col("dst") != F.col("src")) & (urls.domain(F.col("dst")) == urls.domain(F.col("src"))))
    own = own.groupBy("src", "dst").agg(F.min("link_seq").alias("link_seq"))
    once = seeds.distinct().join(own, seeds["url"] == own["src"]).groupBy("crawl_id", "dst").agg(F.min("link_seq").alias("link_seq"))
    order = Window.partitionBy("crawl_id").orderBy("link_seq", "dst")
    ranked = once.withColumn("position", F.row_number().over(order)).filter(F.col("position") < max_pages)
    return first.unionByName(ranked.select("crawl_id", "position", F.col("dst").alias("url")))


def first_visits(requests: DataFrame, order: str, url: str = "url") -> DataFrame:
    """The first request of every normalised URL."""
    row = F.struct(*requests.columns)
    keyed = requests.groupBy(urls.normalize_url(F.col(url)).alias("normalized")).agg(F.min_by(row, F.col(order)).alias("_r"))
    return keyed.select("normalized", "_r.*")


def status_error(status: Column) -> Column:
    """Error text of an HTTP status; null for 200."""
    message = F.concat(F.lit("HTTP "), status)
    for code, text in fixed.STATUS_MESSAGES.items():
        message = F.when(status == code, text).otherwise(message)
    return F.when(status != 200, message)


def outcomes(requests: DataFrame, order: str) -> DataFrame:
    """Requests with ``error``: visited before, excluded, failed, or null.

    ``requests`` has (``order``, url, status_code). Excluded URLs are never visited;
    a failed first visit still counts as one. URLs with very many repeats are joined
    over salted tasks.
    """
    normal = materialize(
        requests.withColumn("normalized", urls.normalize_url(F.col("url"))), "requests"
    )
    firsts = normal.groupBy("normalized").agg(F.min(order).alias("_first"), F.count("*").alias("_copies"))
    joined = join_on_hot_key(normal, firsts, "normalized", "_copies", order)
    excluded = urls.should_exclude_url(F.col("normalized"))
    failed = status_error(F.col("status_code"))
    error = (
        F.when(excluded, "URL excluded by pattern")
        .when(F.col(order) != F.col("_first"), "Already visited")
        .otherwise(failed)
    )
    asked = excluded | (F.col(order) != F.col("_first"))
    return joined.select(
        order, F.when(asked, F.col("url")).otherwise(F.col("normalized")).alias("url"),
        F.when(~asked, F.col("status_code")).alias("status_code"), error.alias("error"),
    )


def split_outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(successes, failures)."""
    return rows.filter(F.col("error").isNull()), rows.filter(F.col("error").isNotNull())


def crawl_summary(pages: DataFrame, key: str = "crawl_id", capped: bool = False) -> DataFrame:
    """Totals per crawl; ``capped`` sums the kept arrays instead of the full counters."""

    def total(name: str) -> Column:
        amount = F.size(name) if capped else F.col(f"{name}_count")
        return F.sum(amount.cast("long")).alias(f"total_{name}")

    return pages.groupBy(key).agg(
        F.count("*").alias("total_pages"),
        *[total(name) for name in ("headings", "paragraphs", "links", "images")],
        F.sum("content_length").alias("total_content_length"),
    )


def run_report(wanted: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per requested URL its outcome, and totals per run.

    ``wanted`` has (run_id, url_no, url), ``results`` (url, error) with one row per URL.
    """
    known = results.select("url", F.col("error").alias("_error"), F.lit(True).alias("_known"))
    # A URL that most runs ask for spreads by run.
    asked = wanted.groupBy("url").agg(F.count("*").alias("_asked"))
    outcome = asked.join(known, "url", "left")
    joined = join_on_hot_key(wanted.withColumn("_run", F.struct("run_id", "url_no")), outcome, "url", "_asked", "_run")
    failure = F.when(F.col("_known").isNull(), F.lit("No result")).otherwise(F.col("_error"))
    detail = joined.select(
        "run_id", "url_no", "url", F.when(failure.isNull(), "completed").otherwise("failed").alias("status"),
        failure.alias("error"),
    )
    totals = detail.groupBy("run_id").agg(
        F.lit("completed").alias("status"), F.count("*").alias("total_urls"),
        F.count_if(F.col("status") == "completed").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
    return detail, totals


def outcome_detail(pages: DataFrame, *keys: str) -> DataFrame:
    """Per enhanced record: title, quality, and how many headings, paragraphs and links it has."""
    internal = F.size(F.filter("links", lambda link: link["type"] == "internal"))
    return pages.select(
        *keys, "title", "quality_score", "headings_count", "paragraphs_count", "links_count",
        internal.cast("long").alias("internal_links"),
    )
