"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.plans.ordered import join_null_safe

TASK_ROWS = 50_000  # rows of one key that a task may take; a ten-thousandth of all rows where that is more


def join_on_hot_key(many: DataFrame, one: DataFrame, key: str, weight: str, spread: str, how: str = "inner") -> DataFrame:
    """Join ``many`` rows to the single row per ``key`` in ``one``.

    ``one`` carries the number of rows per key in ``weight``. A key above one task's share is salted: its rows in ``many``
    spread over as many tasks as its weight asks for, by a hash of ``spread``, and its single row in ``one`` is repeated per
    salt. As a share is at least a ten-thousandth of all rows, at most 10,000 keys are salted, which bounds their broadcast.
    """
    total = one.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_total"))  # one row
    share = F.greatest(F.lit(float(TASK_ROWS)), F.col("_total") / 10_000)
    salts = F.ceil(F.col(weight) / share).cast("bigint")
    hot = one.select(key, weight).join(F.broadcast(total), how="left").select(key, salts.alias("_salts")).filter("_salts > 1")
    hot = F.broadcast(hot)
    first = F.lit(0).cast("bigint")
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_salts"))).otherwise(first)
    salted = join_null_safe(many, hot, [key], "left").withColumn("_salt", salt).drop("_salts")
    copies = F.when(F.col("_salts").isNotNull(), F.sequence(first, F.col("_salts") - 1)).otherwise(F.array(first))
    repeated = join_null_safe(one, hot, [key], "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return join_null_safe(salted, repeated, [key, "_salt"], how).drop("_salt")
