"""Where to look next: scored links, learning paths and search suggestions per crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill import fixed_values as fixed
from pagemill.functions import urls
from pagemill.functions.common import any_of, hits, round_to, unnest
from pagemill.plans.ordered import join_null_safe
from pagemill.plans.skew import join_on_hot_key
from pagemill.plans.stored import materialize


def key_terms(topics: Column, keywords: Column) -> Column:
    """Top three topic names and top ten keywords, each once."""
    names = F.transform(F.slice(topics, 1, 3), lambda t: t["topic"])
    return F.array_distinct(F.concat(names, F.transform(F.slice(keywords, 1, 10), lambda k: k["word"])))


def first_link_per_domain(links: DataFrame, key: str, order: str) -> DataFrame:
    """First usable link of every domain, in link order; texts lower-cased."""
    usable = links.filter((F.col("url") != "") & (F.col("text") != ""))
    row = F.struct("url", F.lower("text").alias("text"), F.col(order))
    grouped = usable.groupBy(key, urls.domain(F.col("url")).alias("domain")).agg(F.min_by(row, F.col(order)).alias("_l"))
    return grouped.select(key, "domain", "_l.*")


def _found(terms: Column, text: Column) -> Column:
    return F.filter(terms, lambda term: F.contains(text, term))


def relevance(url: Column, text: Column, terms: Column, content_type: Column) -> Column:
    """Score between 0 and 1.

    The points are added one by one in rule order: whether a sum near 0.1 passes the
    threshold depends on that floating-point order.
    """
    low_text, low_url = F.lower(text), F.lower(url)
    indicators = F.lit(0)
    for kind, words in fixed.LINK_TYPE_TERMS.items():
        matched = F.lit(0)
        for word in words:
            either = F.contains(low_text, F.lit(word)) | F.contains(low_url, F.lit(word))
            matched = matched + either.cast("int")
        indicators = F.when(content_type == kind, matched).otherwise(indicators)
    steps = F.concat(
        F.array_repeat(F.lit(0.3), F.size(_found(terms, low_text))),
        F.array_repeat(F.lit(0.2), F.size(_found(terms, low_url))),
        F.array_repeat(F.lit(0.15), indicators),
        F.array_repeat(F.lit(0.1), hits(low_text, fixed.EDUCATIONAL_TERMS)),
        F.array_repeat(F.lit(-0.1), hits(low_text, fixed.LOW_QUALITY_TERMS)),
    )
    total = F.aggregate(steps, F.lit(0.0), lambda score, step: score + step)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def reasoning(text: Column, terms: Column, content_type: Column) -> Column:
    """Why a link was kept; matching terms in alphabetical order."""
    low = F.lower(text)
    matching = F.slice(F.array_sort(_found(terms, low)), 1, 3)
    topical = F.when(F.size(matching) > 0, F.concat(F.lit("Contains key topics: "), F.array_join(matching, ", ")))
    kind = (
        F.when(content_type.isin("tutorial", "technical") & any_of(low, ["guide", "tutorial", "documentation"]),
               "Provides learning resources")
        .when(content_type.isin("news", "article") & any_of(low, ["article", "blog", "news"]), "Related news/articles")
        .when(any_of(low, ["course", "learn", "education"]), "Educational content")
    )
    reasons = F.concat_ws("; ", topical, kind)
    return F.when(reasons == "", "Contextually related to current topic").otherwise(reasons)


def scored_links(links: DataFrame, analysis: DataFrame, key: str, order: str) -> DataFrame:
    """First link per domain with its score and reasoning, where the score exceeds 0.1."""
    about = analysis.select(
        key, key_terms(F.col("topics"), F.col("keywords")).alias("_terms"), F.col("content_type.primary_type").alias("_kind")
    )
    firsts = materialize(first_link_per_domain(links, key, order), "first-links")
    # A crawl may hold most domains; its one analysis row meets them in as many tasks as their number asks for.
    sized = join_null_safe(about, firsts.groupBy(key).agg(F.count("*").alias("_domains")), [key])
    joined = join_on_hot_key(firsts, sized, key, "_domains", "domain").drop("_domains")
    score = relevance(F.col("url"), F.col("text"), F.col("_terms"), F.col("_kind"))
    kept = joined.withColumn("_score", score).filter(F.col("_score") > 0.1)
    return kept.select(
        key, "domain", order, "url", "text", round_to(F.col("_score"), 3).alias("relevance_score"),
        reasoning(F.col("text"), F.col("_terms"), F.col("_kind")).alias("reasoning"),
    )


def top_recommendations(scored: DataFrame, key: str, order: str, limit: int = 5) -> DataFrame:
    """Best links per crawl, ties in link order."""
    by = Window.partitionBy(key).orderBy(F.desc("relevance_score"), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def recommendation_outcomes(crawls: DataFrame, scored: DataFrame, totals: DataFrame, key: str, order: str, limit: int = 5) -> DataFrame:
    """One row per crawl: its ``limit`` best links, and why there are none where it has no analysis or no links.

    ``crawls`` has a row per crawl and ``analysed``, whether there is a combined analysis.
    """
    link = F.struct("rank", "url", "text", "relevance_score", "reasoning")
    best = top_recommendations(scored, key, order, limit).groupBy(key).agg(F.sort_array(F.collect_list(link)).alias("recommended_urls"))
    joined = crawls.join(best, key, "left").join(totals, key, "left")
    enough = F.coalesce(F.col("analysed"), F.lit(False)) & (F.coalesce("total_links_analyzed", F.lit(0)) > 0)
    none = F.array().cast(best.schema["recommended_urls"].dataType)
    return joined.select(
        key, F.when(enough, F.coalesce("recommended_urls", none)).otherwise(none).alias("recommended_urls"),
        F.when(~enough, fixed.NO_RECOMMENDATIONS).alias("reasoning"),
        F.coalesce("total_links_analyzed", F.lit(0)).alias("total_links_analyzed"), F.coalesce("unique_domains_found", F.lit(0)).alias("unique_domains_found"),
    )


def link_totals(links: DataFrame, key: str) -> DataFrame:
    """Links analysed and distinct domains of the usable ones."""
    usable = (F.col("url") != "") & (F.col("text") != "")
    # Distinct (key, domain) first: a distinct count over one hot crawl is one task's work.
    per_domain = links.withColumn("_domain", F.when(usable, urls.domain(F.col("url")))).groupBy(key, "_domain").agg(
        F.count("*").alias("_n")
    )
    return per_domain.groupBy(key).agg(
        F.sum("_n").alias("total_links_analyzed"), F.count("_domain").alias("unique_domains_found")
    )


def _dominant(topics: Column) -> Column:
    return F.get(topics, F.lit(0))["topic"]


def learning_path(analysis: DataFrame, key: str) -> DataFrame:
    """Steps for the dominant topic, the generic path for topics without one; no topic, no rows."""

    def path(steps: list[tuple[str, str, list[str]]]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(step).alias("step"), F.lit(text).alias("description"),
                    F.array(*[F.lit(t) for t in terms]).alias("search_terms"),
                )
                for step, text, terms in steps
            ]
        )

    topic = _dominant(F.col("topics"))
    steps = path(fixed.LEARNING_STEPS_GENERIC)
    for name, own in fixed.LEARNING_STEPS.items():
        steps = F.when(topic == name, path(own)).otherwise(steps)
    rows = unnest(analysis, [key], F.when(F.size("topics") > 0, steps), "_s", "_at")
    return rows.select(key, (F.col("_at") + 1).cast("long").alias("step_no"), "_s.*")


def search_suggestions(topics: Column, keywords: Column, content_type: Column, limit: int = 8) -> Column:
    """Queries from the dominant topic, the first frequent keyword and the content type."""
    topic = _dominant(topics)
    frequent = F.filter(F.slice(keywords, 1, 5), lambda k: k["frequency"] > 2)
    keyword = F.get(frequent, F.lit(0))["word"]

    def fill(template: str) -> Column:
        return F.replace(F.replace(F.lit(template), F.lit("{topic}"), topic), F.lit("{keyword}"), keyword)

    none = F.array().cast("array<string>")
    from_keyword = F.when(keyword.isNotNull(), F.array(*[fill(t) for t in fixed.SEARCH_KEYWORD_TEMPLATES])).otherwise(none)
    from_type = none
    for kind, templates in fixed.SEARCH_TYPE_TEMPLATES.items():
        filled = F.array(*[F.replace(F.lit(t), F.lit("{topic}"), topic) for t in templates])
        from_type = F.when(content_type == kind, filled).otherwise(from_type)
    usable = (F.size(topics) > 0) & (F.size(keywords) > 0)
    return F.when(usable, F.slice(F.concat(from_keyword, from_type), 1, limit)).otherwise(none)


def strategy(topics: Column, content_type: Column) -> Column:
    """How the recommendations were made."""
    topic = _dominant(topics)
    focus = F.when(topic.isNotNull(), F.concat(F.lit("Finding content related to "), topic))
    return F.struct(
        F.lit(fixed.STRATEGY_APPROACH).alias("approach"),
        F.array(*[F.lit(factor) for factor in fixed.STRATEGY_FACTORS]).alias("primary_factors"),
        content_type.alias("content_type"),
        topic.alias("dominant_topic"),
        focus.otherwise("General content discovery based on keywords").alias("focus"),
    )
