"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Unicode whitespace, spelt out because \s is ASCII-only in Java and in RE2.
SPACE = r"\t-\r\x1C-\x1F\x{85}\p{Z}"
# The same characters one by one, for the native trim.
SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE_CHARS = "".join(map(chr, SPACE_CODES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    A lambda variable holds a computed value, so the optimizer cannot inline the
    producing expression into every use.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def unnest(df: DataFrame, columns: list, array: Column | str, item: str = "item", pos: str = "pos") -> DataFrame:
    """One row per array element with its position; empty arrays give no rows.

    A plain explode makes the optimizer infer a filter on the array's size and push it
    below, where the array is computed a second time. The outer form does not.
    """
    rows = df.select(*columns, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def strip(value: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.trim(value, F.lit(SPACE_CHARS))


def squeeze(value: Column) -> Column:
    """Trim, and make every whitespace run one space."""
    return strip(F.regexp_replace(value, rf"[{SPACE}]+", " "))


def word_count(value: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(value, F.lit(rf"[^{SPACE}]+"))


def hits(haystack: Column, needles: list[str]) -> Column:
    """How many of ``needles`` occur as substrings."""
    total = F.lit(0)
    for needle in needles:
        total = total + F.contains(haystack, F.lit(needle)).cast("int")
    return total


def any_of(haystack: Column, needles: list[str]) -> Column:
    """Whether any of ``needles`` occurs as a substring."""
    return hits(haystack, needles) > 0


def round_to(value: Column, digits: int) -> Column:
    """Round the exact binary value half-even, as Python's ``round`` does.

    Spark's ``round`` works on the shortest decimal form and differs on ties such as
    10.075, so the number goes through a decimal format instead.
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern)).cast("double") + F.lit(0.0)


def share(condition: Column) -> Column:
    """Percentage of rows where ``condition`` holds; null counts as false."""
    return F.avg(F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)) * 100
