"""Text features of one document as column expressions.

Everything is computed inside the row: word counts come from a sorted array, not
from an explode and a shuffle, so a corpus of any size is a map-only job.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagemill import fixed_values as fixed
from pagemill.functions.common import SPACE, hits, let, round_to, squeeze, strip

NOT_WORD = rf"[^\p{{L}}\p{{N}}_{SPACE}]"
RANKED_TYPE = "array<struct<neg_count:int,first_pos:int,word:string>>"


def tokens(text: Column) -> Column:
    """Lower-case words longer than two characters; punctuation is deleted, not split on."""
    words = F.split(F.regexp_replace(F.lower(text), NOT_WORD, ""), rf"[{SPACE}]+")
    return F.filter(words, lambda word: F.length(word) > 2)


def sentences(text: Column) -> Column:
    """Non-empty trimmed pieces between runs of ``.``, ``!`` and ``?``."""
    pieces = F.transform(F.split(text, "[.!?]+"), strip)
    return F.filter(pieces, lambda piece: piece != "")


def syllables(text: Column) -> Column:
    """Vowel runs over the whole lower-cased text, at least one."""
    return F.greatest(F.lit(1), vowel_runs(text))


def vowel_runs(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit("[aeiouy]+"))


def ranked_words(words: Column, limit: int) -> Column:
    """The ``limit`` most frequent words, ties by first occurrence.

    A sorted word equal to the next is a copy; runs of copies are the words that occur more than once. Only these are sorted
    by count. Set operations keep first occurrences in order, which ranks equal counts and lists the words that occur once.
    """

    def repeated(copies: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(copies) - 1), lambda at: (at == 0) | (F.get(copies, at) != F.get(copies, at - 1))
        )

        def runs(all_starts: Column) -> Column:
            def run(at: Column, nth: Column) -> Column:
                end = F.coalesce(F.get(all_starts, nth + 1), F.size(copies))
                return F.struct(F.get(copies, at).alias("word"), (at - end - 1).alias("neg_count"))

            return F.transform(all_starts, run)

        none = F.array().cast("array<struct<word:string,neg_count:int>>")
        return F.when(F.size(copies) > 0, let(starts, runs)).otherwise(none)

    def ranked(often: Column, names: Column) -> Column:
        firsts = F.transform(F.array_intersect(words, names), lambda word, pos: F.struct(word.alias("word"), pos.alias("pos")))
        counted = F.zip_with(
            often, F.sort_array(firsts),
            lambda run, first: F.struct(run["neg_count"].alias("neg_count"), first["pos"].alias("first_pos"), run["word"].alias("word")),
        )
        n = F.size(names)
        single = F.slice(F.array_except(words, names), 1, F.greatest(F.lit(limit) - n, F.lit(0)))
        singles = F.transform(
            single, lambda word, pos: F.struct(F.lit(-1).alias("neg_count"), (n + pos).alias("first_pos"), word.alias("word"))
        )
        return F.slice(F.concat(F.sort_array(counted), singles), 1, limit)

    copies = let(F.sort_array(words), lambda s: F.filter(s, lambda word, at: word == F.get(s, at + 1)))
    named = let(let(copies, repeated), lambda often: F.struct(often.alias("often"), F.transform(often, lambda run: run["word"]).alias("names")))
    return F.coalesce(let(named, lambda r: ranked(r["often"], r["names"])).cast(RANKED_TYPE), F.array().cast(RANKED_TYPE))


def top_words(ranked: Column, limit: int = 10) -> Column:
    """(word, count) of the first ``limit`` ranked words."""
    return F.transform(
        F.slice(ranked, 1, limit),
        lambda w: F.struct(w["word"].alias("word"), (-w["neg_count"]).cast("long").alias("count")),
    )


def keywords(ranked: Column, n_words: Column, limit: int = 10) -> Column:
    """Repeated words among the 20 most frequent with f/n * ln(n/f), in frequency order."""
    repeated = F.filter(F.slice(ranked, 1, 20), lambda w: w["neg_count"] < -1)

    def scored(w: Column) -> Column:
        freq = -w["neg_count"]
        weight = freq / n_words * F.log(n_words / freq)
        return F.struct(
            w["word"].alias("word"), freq.cast("long").alias("frequency"), round_to(weight, 4).alias("importance")
        )

    return F.slice(F.transform(repeated, scored), 1, limit)


def basic_stats(words: Column, n_sentences: Column, ranked: Column) -> Column:
    n = F.nullif(F.size(words), F.lit(0))
    unique = F.size(F.array_distinct(words))
    letters = F.aggregate(words, F.lit(0), lambda total, word: total + F.length(word))
    per_sentence = F.coalesce(round_to(n / F.nullif(n_sentences, F.lit(0)), 2), F.lit(0.0))
    stats = F.struct(
        n.cast("long").alias("total_words"),
        unique.cast("long").alias("unique_words"),
        round_to(letters / n, 2).alias("avg_word_length"),
        per_sentence.alias("avg_sentence_length"),
        top_words(ranked).alias("most_common_words"),
        round_to(unique / n, 3).alias("vocabulary_diversity"),
    )
    return F.when(n > 0, stats)


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    """Unclamped Flesch reading ease; null without words or sentences."""
    n_words, n_sentences = F.nullif(n_words, F.lit(0)), F.nullif(n_sentences, F.lit(0))
    return 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)


def readability(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    def describe(both: Column) -> Column:
        score, grade = both["score"], both["grade"]
        level = F.lit(fixed.READABILITY_LOWEST)
        for floor, name in reversed(fixed.READABILITY_BANDS):
            level = F.when(score >= floor, name).otherwise(level)
        result = F.struct(
            round_to(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1).alias("flesch_reading_ease"),
            round_to(F.greatest(F.lit(0.0), grade), 1).alias("flesch_kincaid_grade"),
            level.alias("readability_level"),
        )
        return F.when(score.isNotNull(), result)

    def scores(c: Column) -> Column:
        n, m, syl = c["n"], c["m"], c["syl"]
        grade = 0.39 * (n / m) + 11.8 * (syl / n) - 15.59
        return let(F.struct(reading_ease(n, m, syl).alias("score"), grade.alias("grade")), describe)

    n, m = F.nullif(n_words, F.lit(0)), F.nullif(n_sentences, F.lit(0))
    return let(F.struct(n.alias("n"), m.alias("m"), n_syllables.alias("syl")), scores)


def count_in(words: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(words, lambda word: word.isin(lexicon)))


def counts_in(words: Column, lexicons: dict[str, list[str]]) -> Column:
    """Struct of :func:`count_in` for several lists, from one pass over the words and one over those in any list."""
    listed = F.filter(words, lambda word: word.isin(sorted({word for lexicon in lexicons.values() for word in lexicon})))
    return let(listed, lambda few: F.struct(*[count_in(few, lexicon).alias(name) for name, lexicon in lexicons.items()]))


def sentiment_from_counts(positive: Column, negative: Column, n_words: Column) -> Column:
    score = (positive - negative) / n_words
    confidence = F.least(F.lit(1.0), (positive + negative) / n_words * 2)
    label = F.when(score > 0.05, "positive").when(score < -0.05, "negative").otherwise("neutral")
    empty = F.coalesce(n_words, F.lit(0)) == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(round_to(score, 3)).alias("score"),
        F.when(empty, "neutral").otherwise(label).alias("label"),
        F.when(empty, 0.0).otherwise(round_to(confidence, 3)).alias("confidence"),
        positive.cast("long").alias("positive_words"),
        negative.cast("long").alias("negative_words"),
    )


def sentiment(words: Column) -> Column:
    counts = counts_in(words, {"p": fixed.POSITIVE_WORDS, "q": fixed.NEGATIVE_WORDS})
    return let(counts, lambda c: sentiment_from_counts(c["p"], c["q"], F.nullif(F.size(words), F.lit(0))))


def topics_from_hits(matches: dict[str, Column]) -> Column:
    """Top five topics by confidence, ties in lexicon order."""
    rows = []
    for place, (topic, lexicon) in enumerate(fixed.TOPIC_KEYWORDS.items()):
        confidence = round_to(F.least(F.lit(1.0), matches[topic] / len(lexicon)), 3)
        rows.append(
            F.struct(
                (-confidence).alias("neg_confidence"),
                F.lit(place).alias("place"),
                F.lit(topic).alias("topic"),
                matches[topic].cast("long").alias("matches"),
            )
        )
    found = F.filter(F.array(*rows), lambda t: t["matches"] > 0)
    return F.transform(
        F.slice(F.sort_array(found), 1, 5),
        lambda t: F.struct(
            t["topic"].alias("topic"),
            (-t["neg_confidence"]).alias("confidence"),
            t["matches"].alias("keyword_matches"),
        ),
    )


def topics(lower_text: Column) -> Column:
    found = F.struct(*[hits(lower_text, words).alias(name) for name, words in fixed.TOPIC_KEYWORDS.items()])
    return let(found, lambda n: topics_from_hits({name: n[name] for name in fixed.TOPIC_KEYWORDS}))


def content_type_from_hits(scores: dict[str, Column]) -> Column:
    rows = [
        F.struct((-scores[name]).cast("long").alias("neg"), F.lit(place).alias("place"), F.lit(name).alias("name"))
        for place, name in enumerate(fixed.TYPE_INDICATORS)
    ]

    def decide(found: Column) -> Column:
        best = F.get(found, F.lit(0))
        none = F.size(found) == 0
        return F.struct(
            F.when(none, "general").otherwise(best["name"]).alias("primary_type"),
            F.when(none, 0.5).otherwise(round_to(F.least(F.lit(1.0), -best["neg"] / 3), 3)).alias("confidence"),
            F.map_from_entries(F.transform(found, lambda t: F.struct(t["name"], -t["neg"]))).alias("all_scores"),
        )

    return let(F.sort_array(F.filter(F.array(*rows), lambda t: t["neg"] < 0)), decide)


def content_type(lower_text: Column) -> Column:
    """Type with most indicator hits, ties in lexicon order; ``general`` when none hits."""
    return content_type_from_hits({name: hits(lower_text, words) for name, words in fixed.TYPE_INDICATORS.items()})


def language_from_counts(english: Column, spanish: Column, n_words: Column) -> Column:
    def sure(count: Column) -> Column:
        return round_to(F.least(F.lit(1.0), count / n_words * 2), 3)

    return F.struct(
        F.when(english > spanish, "english").when(spanish > english, "spanish").otherwise("unknown")
        .alias("detected_language"),
        F.when(english > spanish, sure(english)).when(spanish > english, sure(spanish)).otherwise(0.5)
        .alias("confidence"),
    )


def language(words: Column) -> Column:
    counts = counts_in(words, {"e": fixed.ENGLISH_WORDS, "s": fixed.SPANISH_WORDS})
    return let(counts, lambda c: language_from_counts(c["e"], c["s"], F.nullif(F.size(words), F.lit(0))))


def summary(text: Column, pieces: Column) -> Column:
    """All of up to three sentences, else the first, the middle and the last."""

    def choose(all_pieces: Column) -> Column:
        n = F.size(all_pieces)
        ends = F.array(
            F.get(all_pieces, F.lit(0)), F.get(all_pieces, (n / 2).cast("int")), F.get(all_pieces, n - 1)
        )
        joined = F.concat_ws(" ", F.when(n <= 3, all_pieces).otherwise(ends))
        return F.struct(joined.alias("text"), n.alias("n"))

    def describe(chosen: Column) -> Column:
        length = F.length(chosen["text"])
        ratio = round_to(length / F.nullif(F.length(text), F.lit(0)), 3)
        return F.struct(
            chosen["text"].alias("summary"),
            length.cast("long").alias("summary_length"),
            F.when(chosen["n"] > 0, ratio).alias("compression_ratio"),
        )

    return let(let(pieces, choose), describe)


def entities(text: Column) -> Column:
    """Distinct matches of each entity pattern, sorted."""
    return F.struct(*[values.alias(kind) for kind, values in entities_by_kind(text).items()])


def entities_by_kind(text: Column) -> dict[str, Column]:
    """The fields of :func:`entities`."""

    def found(pattern: str) -> Column:
        # (?U): \b and \d follow Unicode, as in the patterns' home language.
        # A digit is looked for before the border in front of it, which is dearer to tell.
        guarded = f"(?=\\d){pattern}" if pattern.startswith(r"\b\d") else pattern
        matches = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + guarded), F.lit(0))))
        if "@" not in pattern:
            return matches
        # The search for a sign that every match holds is far cheaper than the pattern.
        return F.when(F.contains(text, F.lit("@")) | text.isNull(), matches).otherwise(F.array().cast("array<string>"))

    return {name: found(pattern) for name, pattern in fixed.ENTITY_PATTERNS.items()}


def too_short(text: Column) -> Column:
    """Texts the analysis answers with the fixed empty result."""
    return F.coalesce(F.length(strip(text)), F.lit(0)) < 10


def clean_for_storage(text: Column) -> Column:
    """Single spaces; only word characters, spaces and ``.,!?-:`` stay."""
    kept = F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{SPACE}.,!?\-:]", "")
    return strip(kept)


def page_text(title: Column, headings: Column, paragraphs: Column) -> Column:
    """Title, headings and paragraphs joined with single spaces, as analysed."""
    return F.concat(
        F.coalesce(title, F.lit("")), F.lit(" "),
        F.concat_ws(" ", headings), F.lit(" "),
        F.concat_ws(" ", paragraphs),
    )


def fingerprint(prefix: Column | str, args: list[Column], named: Column | None = None) -> Column:
    """MD5 of prefix, positional values and sorted ``name:value`` pairs joined by ``:``."""
    first = F.lit(prefix) if isinstance(prefix, str) else prefix
    parts = [first, *[arg.cast("string") for arg in args]]
    if named is not None:
        pairs = F.transform(F.array_sort(F.map_entries(named)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
        parts.append(F.when(F.size(pairs) > 0, F.concat_ws(":", pairs)))
    return F.md5(F.concat_ws(":", *parts))
