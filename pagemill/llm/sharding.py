"""Shard placement by a permutation-filled lookup table, with DataFrame functions only.

Every shard has a permutation of the slots of a prime-sized table, from two hashes of its name. The shards take turns, each
claiming the next slot of its permutation that is still free. A row's key hashes to a slot, so placement is one lookup in a table
whose size is fixed by a parameter. Adding or removing a shard moves few keys beyond its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLE = 65_537  # slots; a prime of at least a hundred times the number of shards spreads within about a percent
LARGEST = 10_000_000  # slots at most: the table is broadcast


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], slots: int = TABLE, weights: Mapping[str, float] | None = None) -> list[int]:
    """Shard number of every slot. The outcome depends on names and weights, not on the order of ``shards``.

    A shard of weight w claims w slots for each slot of one of weight 1 (turns are kept as running credit).
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be unique, and there must be one at least")
    if not _prime(slots) or slots < len(shards) or slots > LARGEST:
        raise ValueError(f"slots must be a prime between the number of shards and {LARGEST}")
    share = {s: float((weights or {}).get(s, 1.0)) for s in shards}
    if min(share.values()) < 0 or not max(share.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    top = max(share.values())
    turn = sorted(s for s in shards if share[s] > 0)
    number = {s: i for i, s in enumerate(shards)}
    place = {s: _hash(s, "offset") % slots for s in turn}
    skip = {s: _hash(s, "skip") % (slots - 1) + 1 if slots > 2 else 1 for s in turn}
    credit = dict.fromkeys(turn, 0.0)
    table, free = [-1] * slots, slots
    while free:
        for s in turn:
            credit[s] += share[s] / top
            if credit[s] < 1 - 1e-9:
                continue
            credit[s] -= 1
            at = place[s]
            while table[at] >= 0:
                at = (at + skip[s]) % slots
            table[at] = number[s]
            place[s] = (at + skip[s]) % slots
            free -= 1
            if not free:
                break
    return table


def slot_of(keys: Sequence[Column], slots: int) -> Column:
    """Slot of a row: a hash of its key columns; nulls hash like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots).cast("long")).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = TABLE, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``(slot, shard)``, a row per slot."""
    table = lookup_table(shards, slots, weights)
    numbers, names = (F.from_json(F.lit(json.dumps(x)), f"array<{kind}>") for x, kind in ((table, "int"), (list(shards), "string")))
    rows = spark.range(1).select(F.posexplode(numbers).alias("slot", "n"), names.alias("names"))
    return rows.select("slot", F.get("names", F.col("n")).alias("shard"))


def assign(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = TABLE, weights: Mapping[str, float] | None = None, name: str = "shard", slot_name: str = "slot") -> DataFrame:
    """``df`` with the slot and shard of every row; rows of equal keys go to the same shard.

    The lookup table has ``slots`` rows whatever the data, so its broadcast is bounded. Rows with null keys are placed like any other;
    repeated rows share a shard; an empty table stays empty. New column names must not exist in ``df``.
    """
    if clash := {name, slot_name} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    table = table_frame(df.sparkSession, shards, slots, weights).withColumnsRenamed({"slot": "_table_slot", "shard": "_table_shard"})
    placed = df.withColumn(slot_name, slot_of([df[k] for k in keys], slots))
    joined = placed.join(F.broadcast(table), placed[slot_name] == table["_table_slot"])
    return joined.select(*[placed[c] for c in placed.columns], table["_table_shard"].alias(name))


def loads(placed: DataFrame, name: str = "shard", size: str | None = None) -> DataFrame:
    """Rows, and the sum of ``size``, per shard."""
    sums = [F.count("*").alias("rows")] + ([F.sum(size).alias("total")] if size else [])
    return placed.groupBy(name).agg(*sums)


def write(placed: DataFrame, path: str, name: str = "shard", files_per_shard: int = 8) -> None:
    """One folder per shard, each written by up to ``files_per_shard`` tasks, so that a heavy shard is no single task."""
    salted = placed.repartition(F.col(name), F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard)))
    salted.write.partitionBy(name).parquet(path)
