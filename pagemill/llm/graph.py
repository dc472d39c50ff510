"""Connected components of a link table, by alternating stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.plans.stored import materialize


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum: two numbers that change while links change."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """``(a, b)`` links between long keys -> ``(node, root)``: the smallest key reachable.

    Every round hangs each key's larger neighbours, then its smaller ones, on the smallest
    (large-star, small-star), which halves distances; a round is two groupings with map-side
    minimum and two joins, stored in the shared folder. Self-links and nulls are ignored, repeated links
    count once, an empty table gives an empty one. Only keys with a link to another key appear.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.filter("a > b").distinct(), "links")
    before = _state(links)
    for _ in range(limit):
        if not before[0]:
            break
        both = links.union(links.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, both.a == least.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(least, large.a == least.u)
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        links = materialize(small.select("e.a", "e.b").filter("a > b").distinct(), "links")
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(ends.select(F.col("root").alias("node"), "root")).distinct()
