"""Ordered computations without a window that puts a whole key into one task.

A window partitioned by key sends every row of a key to one task. Here rows are
range-partitioned by (key, order) instead, so a key of any size spreads over many
slices. A slice knows its local position; a small table with one row per
(slice, key) carries what the earlier slices hold. The order must be unique.

Range partitioning reads its input twice (once to sample the boundaries): hand in a
projection of a scan, or materialize costly columns first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.plans.stored import materialize

SLICE, LOCAL = "_slice", "_local"
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    columns = [*[F.col(k).asc() for k in keys], *order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    place = F.monotonically_increasing_id()
    ranged = ranged.withColumn("_place", place)
    ranged = ranged.withColumn(SLICE, F.shiftright("_place", ROW_BITS)).withColumn(
        LOCAL, F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    )
    # Stored, so that every use below sees the same slice boundaries.
    return materialize(ranged.drop("_place"), "ordered")


def _earlier(per_slice: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per (slice, key), the sums of ``columns`` over earlier slices of the key."""
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    window = window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"_before_{c}") for c in columns]
    return per_slice.select(SLICE, *keys, "_first", *before)


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name where null matches null; the right copies are dropped."""
    renamed = right.withColumnsRenamed({name: f"_right_{name}" for name in on})
    condition = reduce(Column.__and__, [left[name].eqNullSafe(renamed[f"_right_{name}"]) for name in on])
    return left.join(renamed, condition, how).drop(*[f"_right_{name}" for name in on])


def row_index(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """0-based position of every row within its key, in ``order``."""
    sliced = _sliced(df, keys, order)
    per_slice = sliced.groupBy(SLICE, *keys).agg(F.min(LOCAL).alias("_first"), F.count("*").alias("rows"))
    earlier = _earlier(per_slice, keys, ["rows"])
    joined = join_null_safe(sliced, earlier, [SLICE, *keys])
    index = (F.col(LOCAL) - F.col("_first") + F.col("_before_rows")).cast("long")
    return joined.select(*df.columns, index.alias(name))


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: dict[str, str], keys: Sequence[str] = (), index: str | None = None
) -> DataFrame:
    """Inclusive running sums: ``totals`` maps an input column to the name of its running sum."""
    sliced = _sliced(df, keys, order)
    sums = [F.sum(column).alias(name) for column, name in totals.items()]
    per_slice = sliced.groupBy(SLICE, *keys).agg(F.min(LOCAL).alias("_first"), F.count("*").alias("rows"), *sums)
    earlier = _earlier(per_slice, keys, ["rows", *totals.values()])
    within = Window.partitionBy(SLICE, *keys).orderBy(LOCAL).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(column).over(within).alias(f"_here_{name}") for column, name in totals.items()])
    joined = join_null_safe(local, earlier, [SLICE, *keys])
    out = [(F.col(f"_here_{name}") + F.col(f"_before_{name}")).alias(name) for name in totals.values()]
    if index:
        out.append((F.col(LOCAL) - F.col("_first") + F.col("_before_rows")).cast("long").alias(index))
    return joined.select(*df.columns, *out)


def trailing_window(
    df: DataFrame,
    order: Sequence[Column],
    size: int,
    aggregates: dict[str, Column],
    keys: Sequence[str] = (),
    segment_rows: int = 50_000,
) -> DataFrame:
    """Aggregates over the last ``size`` rows up to each row of a key.

    Rows go to segments of fixed length by their index; the last ``size - 1`` rows
    of a segment are also sent to the next one, so every segment is complete on its
    own and no task sees more than one segment of a key.
    """
    if segment_rows < size:
        raise ValueError("a segment must hold at least one whole window")
    indexed = row_index(df, order, keys, "_index")
    segment = F.floor(F.col("_index") / segment_rows)
    tail = F.col("_index") % segment_rows >= segment_rows - (size - 1)
    targets = F.when(tail, F.array(segment, segment + 1)).otherwise(F.array(segment))
    spread = indexed.withColumn("_own", segment).withColumn("_segment", F.explode(targets))
    frame = Window.partitionBy(*keys, "_segment").orderBy("_index").rowsBetween(-(size - 1), 0)
    computed = spread.select("*", *[expr.over(frame).alias(name) for name, expr in aggregates.items()])
    return computed.filter("_own = _segment").select(*df.columns, *aggregates)


def exact_percentiles(
    df: DataFrame, value: str, fractions: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated percentiles per key.

    Equal values are counted first; running counts over the range-sorted distinct
    values then locate the two ranks each percentile needs. No task holds a key.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = materialize(counts, "value-counts")
    ranked = running_totals(counts, [F.col(value).asc()], {"_n": "_upto"}, keys)
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        placed = join_null_safe(ranked, sizes, keys)
    else:
        placed = ranked.withColumn("_total", F.lit(sizes.first()["_total"]).cast("long"))  # one number
    picks = []
    for name, fraction in fractions.items():
        spot = (F.col("_total") - 1) * F.lit(fraction)
        low, high = F.floor(spot), F.ceil(spot)
        covers = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        left = F.max(F.when(covers(low), F.col(value)))
        right = F.max(F.when(covers(high), F.col(value)))
        part = F.max(spot - low)
        picks.append((left + (right - left) * part).alias(name))
    return placed.groupBy(*keys).agg(*picks)
