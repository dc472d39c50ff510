"""Threshold-scaled document fingerprints, with DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so sketches of one text's parts merge by
union and overlaps of very unequal documents are estimated without bias. A text whose shingles all lie above keeps its smallest
hash, so that only texts without words have an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

FRACTION_BITS = 3  # hashes below 2**64 / 2**3 are kept
SHINGLE = 5
RANGES_PER_PARTITION = 4


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def sketch(text: Column, shingle: int = SHINGLE, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sorted distinct hashes of ``shingle`` consecutive words, those below the threshold.

    Fewer words count as one shingle; a null text is an empty one; a text without words gives an empty array.
    """
    hashes = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        ends = F.sequence(F.lit(0), n - shingle)
        rolled = F.transform(ends, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        whole = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= shingle, rolled).when(n > 0, whole).otherwise(F.array().cast("array<long>"))

    limit = F.lit(1 << (64 - fraction_bits)).cast("long") if fraction_bits > 1 else F.lit((1 << 63) - 1)

    def kept(s: Column) -> Column:
        low = F.filter(s, lambda x: (x >= 0) & (x < limit))
        least = F.array(F.array_min(F.transform(s, lambda x: x.bitwiseXOR(F.lit(-(1 << 63))))).bitwiseXOR(F.lit(-(1 << 63))))
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(s) > 0, least).otherwise(s)

    return _let(_let(hashes, shingles), kept)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merge(left: Column, right: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """Sketch of the union of two shingle sets."""
    limit = F.lit(1 << (64 - fraction_bits)).cast("long")
    both = F.array_sort(F.array_union(left, right))
    low = F.filter(both, lambda x: (x >= 0) & (x < limit))
    return F.when(F.size(low) > 0, low).otherwise(F.slice(both, 1, 1))


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingle sets; 1 for two empty sketches."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def containment(left: Column, right: Column) -> Column:
    """Estimated share of the left text's shingles that the right one has; 1 where the left has none."""
    return F.when(F.size(left) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / F.size(left))


def as_text(hashes: Column) -> Column:
    """The sketch as hex digits, 16 per hash, in ascending order."""
    return F.concat_ws("", F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below ``value``, counted in two steps of about the root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    group = F.size(F.filter(heads, lambda b: b <= value))
    within = F.size(F.filter(F.get(inner, group - 1), lambda b: b <= value))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + within)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, sketch, next_text, next_sketch)``: each row with the row after it by ascending id.

    The row after the last is the first; rows of equal id follow by text, null ids come first, a null text is empty. Ranges of ids from
    approximate quantiles spread the rows, so the text moves once; each range also gets the first row of the range after it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, RANGES_PER_PARTITION * partitions)
    found = rows.select("doc_id").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    bounds = sorted({int(b) for b in found})
    key = F.coalesce(_range_of(F.col("doc_id"), bounds), F.lit(-1))
    least = rows.select(key.alias("range"), "doc_id").groupBy("range").agg(F.min("doc_id").alias("first")).orderBy("range").collect()
    if not least:
        starts = spark.createDataFrame([], "first long, before int")
    else:  # at most one row per range
        ring = [r["range"] for r in least]
        starts = spark.createDataFrame([(r["first"], ring[i - 1]) for i, r in enumerate(least)], "first long, before int")
    marked = rows.withColumn("range", key.cast("int")).join(F.broadcast(starts), F.col("doc_id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("range"), F.lit(False).alias("extra"))
    borrowed = F.struct(F.col("before").alias("range"), F.lit(True).alias("extra"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, borrowed))
    placed = marked.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.range", "p.extra")
    dealt = placed.repartition("range").withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    after = dealt.select(
        "doc_id", "text", "sketch", "extra",
        F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"),
    )
    return after.filter(~F.col("extra")).drop("extra")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text has its last quarter of code points replaced by as many from the start of the next document, or
    by all of it. Repeated rows come back repeated; a table of one row is its own next; an empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    quarter = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = rows.withColumn("edited", edited)
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch",
        sketch(F.col("edited")).alias("edited_sketch"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
