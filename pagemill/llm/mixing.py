"""Mixing sources to target weights over a tree of domains, languages and sources.

A token budget flows down the tree by weight. A child takes at most what its leaves can give (their tokens times
the epochs allowed); what it cannot take goes to its siblings by weight, and only what a whole family cannot take goes back to the family's siblings.
A leaf fills its budget with whole epochs of its documents, each in a seeded order of its own, and a prefix by tokens of one more.
Everything is DataFrame work: the tree is a table of leaves, and documents meet it as one join on their leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagemill.plans.ordered import join_null_safe
from pagemill.plans.stored import materialize

BUCKETS = 4_096  # slices of a leaf's order; only the slice in which the prefix ends is ordered row by row
NONE = "∅"  # name of a missing branch


def word_tokens(text: Column) -> Column:
    """Tokens of a text: words between ASCII white space, plus one end mark."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return (F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1) + 1).cast("long")


def _weight(levels: Sequence[Column], weights: Mapping[tuple, float]) -> Column:
    """Weight of a branch among its siblings: by its path of names, by its last name alone, or 1."""
    expression = F.lit(1.0)
    named = sorted(weights.items(), key=lambda item: len(item[0]))
    for path, value in named:
        if len(path) == len(levels):
            hit = F.lit(True)
            for level, name in zip(levels, path):
                if name is not None:
                    hit = hit & (level == name)
            expression = F.when(hit, F.lit(float(value))).otherwise(expression)
    return expression


def _fill(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """``children`` of one level with ``budget``: the parents' ``_given`` shared by ``_weight`` up to ``_room`` each.

    With children in ascending order of room per weight, those before the first that is not exhausted take all they have, and the
    others share the rest by weight.
    """
    ratio = F.when(F.col("_weight") > 0, F.col("_room") / F.col("_weight")).otherwise(F.lit(float("inf")))
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ranked = children.withColumn("_ratio", ratio)
    before = family.orderBy("_ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    after = family.orderBy("_ratio", name).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.select(
        "*", F.coalesce(F.sum("_room").over(before), F.lit(0.0)).alias("_spent"), F.sum("_weight").over(after).alias("_sharing")
    )
    level = F.when(F.col("_sharing") > 0, (F.col("_given") - F.col("_spent")) / F.col("_sharing")).otherwise(F.lit(0.0))
    full = (F.col("_weight") > 0) & (F.col("_ratio") <= level)
    ranked = ranked.withColumn("_full", full)
    rest = F.col("_given") - F.sum(F.when(F.col("_full"), F.col("_room")).otherwise(0.0)).over(family)
    shares = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(family)
    ranked = ranked.select("*", rest.alias("_rest"), shares.alias("_shares"))
    part = F.when(F.col("_shares") > 0, F.col("_rest") * F.col("_weight") / F.col("_shares")).otherwise(0.0)
    budget = F.when(F.col("_full"), F.col("_room")).otherwise(F.greatest(F.lit(0.0), F.least("_room", part)))
    return ranked.select(*children.columns, budget.alias("budget"))


def budgets(leaves: DataFrame, levels: Sequence[str], total: float | Column, weights: Mapping[tuple, float], max_epochs: float) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``budget``: the tokens each leaf contributes.

    ``weights`` maps a path of names, such as ``("web",)`` or ``("web", "en")``, to a weight among siblings; None in a path matches any
    name, and branches without an entry weigh 1. A branch whose leaves all have weight 0 gets nothing. ``total`` above what the whole
    tree can give is reduced to that.
    """
    usable = F.lit(1.0)
    for depth in range(1, len(levels) + 1):
        usable = F.when(_weight([F.col(c) for c in levels[:depth]], weights) > 0, usable).otherwise(F.lit(0.0))
    rows = leaves.withColumn("_capacity", F.col("tokens") * F.lit(float(max_epochs)) * usable)
    given: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = rows.groupBy(*path).agg(F.sum("_capacity").alias("_room"))
        nodes = nodes.withColumn("_weight", F.when(F.col("_room") > 0, _weight([F.col(c) for c in path], weights)).otherwise(F.lit(0.0)))
        if given is None:
            whole = rows.agg(F.least(F.coalesce(F.sum("_capacity"), F.lit(0.0)), total if isinstance(total, Column) else F.lit(float(total))).alias("_given"))
            nodes = nodes.join(F.broadcast(whole), how="left")  # one row
        else:
            nodes = nodes.join(given.select(*parent, F.col("budget").alias("_given")), parent)
        given = _fill(nodes, parent, levels[depth - 1])
    return leaves.join(given.select(*levels, "budget"), list(levels))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    share: float | None = None,
    total: float | None = None,
    weights: Mapping[tuple, float] | None = None,
    max_epochs: float = 1.0,
    seed: int = 0,
    tokens: Column | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Every row of ``docs`` with its leaf, ``n_tokens`` and ``copies``: how often the mixture holds it (0: not at all).

    ``levels`` names the branches from the root down. The budget is ``total`` tokens, or ``share`` of all tokens. A leaf's prefix
    holds the documents whose middle token lies within its budget, so it is off by half a document at most. Rows of equal doc_id in one leaf share their place in the order and enter together; a null
    branch is a branch of its own; null texts have one token; an empty table gives no rows. Columns of ``docs`` are kept; new names
    must not exist in it.
    """
    new = [*levels, "n_tokens", "copies"]
    if clash := set(new) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    if (share is None) == (total is None):
        raise ValueError("give either share or total")
    names = list(levels)
    measured = docs.select(
        "*", *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()],
        (word_tokens(F.col("text")) if tokens is None else tokens).cast("long").alias("n_tokens"),
    )
    bucket_of = lambda key: F.shiftrightunsigned(key, 64 - BUCKETS.bit_length() + 1)
    narrow = materialize(measured.select(*names, id_col, "n_tokens"), "mixing-lengths")
    leaves = narrow.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    budget_all = F.lit(float(total)) if total is not None else F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))
    leaves = materialize(leaves.withColumn("_total", budget_all), "mixing-leaves")
    whole = leaves.agg(F.max("_total").alias("t")).first()["t"] or 0.0  # one number
    planned = budgets(leaves.drop("_total"), names, whole, weights or {}, max_epochs)
    planned = planned.select(
        *names, F.floor(F.col("budget") / F.col("tokens") + 1e-12).cast("int").alias("_epochs"), "budget", "tokens",
    )
    planned = planned.withColumn("_need", F.col("budget") - F.col("_epochs") * F.col("tokens"))
    planned = materialize(planned, "mixing-plan")
    placed = narrow.join(planned.select(*names, "_epochs", "_need"), names)
    placed = placed.withColumn("_key", F.xxhash64(F.lit(seed), "_epochs", *names, id_col)).withColumn("_bucket", bucket_of(F.col("_key")))
    sums = placed.groupBy(*names, "_bucket").agg(F.sum("n_tokens").alias("_tokens"), F.max("_need").alias("_need"))
    running = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_tokens").over(running), F.lit(0)))
    ends = sums.filter((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_tokens") >= F.col("_need")))
    ends = materialize(ends.select(*names, "_bucket", "_before"), "mixing-ends")
    last = placed.join(ends, [*names, "_bucket"])
    unsigned = F.col("_key").bitwiseXOR(F.lit(-(1 << 63)))
    ties = last.groupBy(*names, "_key").agg(F.sum("n_tokens").alias("n"), F.max("_need").alias("_need"), F.max("_before").alias("_before"))
    inside = Window.partitionBy(*names).orderBy(unsigned).rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("_at", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    reached = F.when(F.col("_at") + F.col("n") / 2 <= F.col("_need"), unsigned)
    cut = ties.groupBy(*names).agg(F.max(reached).alias("_cut"), F.min(unsigned).alias("_from"))
    decided = materialize(planned.join(cut, names, "left").select(*names, "_epochs", "_cut", "_from"), "mixing-cuts")
    renamed = decided.withColumnsRenamed({n: f"_leaf_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & (measured[n] == renamed[f"_leaf_{n}"])
    joined = measured.join(renamed, on)
    key = F.xxhash64(F.lit(seed), renamed["_epochs"], *[measured[n] for n in names], measured[id_col])
    place = key.bitwiseXOR(F.lit(-(1 << 63)))
    within = (place < renamed["_from"]) | F.coalesce(place <= renamed["_cut"], F.lit(False))
    copies = renamed["_epochs"] + F.when(F.coalesce(within, F.lit(False)), 1).otherwise(0)
    return joined.select(*[measured[c] for c in [*docs.columns, *names, "n_tokens"]], copies.cast("int").alias("copies"))


def domain_of(source: Column, domains: int = 3) -> Column:
    """A stand-in domain for tables without one: a fixed hash of the source name."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % domains).cast("string"))
