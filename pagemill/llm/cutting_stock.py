"""Packing as a cutting-stock problem, solved by column generation over a length histogram.

Spark tokenizes, cuts documents into full sequences and a remainder, and counts remainders per length class: a
histogram of at most ``width / grain`` numbers, whatever the corpus size. The driver solves the linear program over patterns of
classes (revised simplex; a knapsack dynamic program prices new patterns), rounds it down and fits the few items left.
Back in Spark every piece has a rank within its class, and patterns own intervals of ranks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.llm.bestfit import best_fit
from pagemill.llm.tokens import encoder
from pagemill.plans.stored import materialize

GAP = 5e-4  # relative distance to the linear bound at which pricing stops
ROUNDS = 20
SCALED = 20_000  # items of the packing that the first patterns come from
TOGETHER = 64  # patterns of one knapsack table that may join the pool


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price of a pattern within 0..``room`` units, items unlimited, and the item taken last (-1: none)."""
    value, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        k = fitting[c]
        value[c] = value[c - 1]
        if k:
            options = prices[:k] + value[c - sizes[:k]]
            best = options.argmax()
            if options[best] > value[c] + 1e-12:
                value[c], taken[c] = options[best], best
    return value, taken


def _pattern(sizes: np.ndarray, taken: np.ndarray, first: int, room: int) -> np.ndarray:
    """The best pattern that holds item ``first``."""
    pattern, c = np.zeros(len(sizes)), room - int(sizes[first])
    pattern[first] = 1
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= int(sizes[taken[c]])
    return pattern


def _first_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> np.ndarray:
    """Patterns of a best-fit packing of the histogram, scaled down to a bounded number of items."""
    scaled = np.ceil(demand * min(1.0, SCALED / demand.sum())).astype(int)
    items = np.repeat(np.arange(len(sizes)), scaled)
    rows = {tuple(sorted(items[row].tolist())) for row in best_fit(sizes[items].tolist(), room)}
    return np.array([np.bincount(row, minlength=len(sizes)) for row in sorted(rows)], dtype=float)


def _refreshed(basis: np.ndarray, inverse: np.ndarray, use: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse computed anew; the updated one where rounding has made the basis singular (a plan stays valid with it)."""
    try:
        inverse = np.linalg.inv(basis)
    except np.linalg.LinAlgError:
        return inverse, use
    return inverse, np.maximum(inverse @ demand, 0)


def fractional(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in a near-optimal solution of the linear program.

    The pool starts with the patterns of a best-fit packing. Each round solves the program over the pool
    (revised simplex, keeping the inverse of the basis), then one knapsack table prices the best pattern around each item
    and the most promising join the pool, until the solution is within ``GAP`` of the bound.
    """
    basis = np.diag((room // sizes).astype(float))  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    bound = demand @ sizes / room
    pool = _first_patterns(sizes, demand, room)
    for _ in range(ROUNDS):
        for pivot in range(20 * len(sizes)):
            worth = pool @ inverse.sum(axis=0)
            entering = int(worth.argmax())
            if worth[entering] <= 1 + 1e-7 or use.sum() - bound <= GAP * bound:
                break
            step = inverse @ pool[entering]
            rising = step > 1e-6
            if not rising.any():
                break
            ratio = np.where(rising, use / np.where(rising, step, 1), np.inf)
            amount = ratio.min()
            tied = ratio <= amount * (1 + 1e-9) + 1e-12
            leaving = int(np.where(tied, step, 0).argmax())  # the largest pivot keeps the basis well-conditioned
            use = np.maximum(use - amount * step, 0)
            use[leaving] = amount
            basis[:, leaving] = pool[entering]
            inverse[leaving] /= step[leaving]
            step[leaving] = 0
            inverse -= np.outer(step, inverse[leaving])
            if pivot % 100 == 99:
                inverse, use = _refreshed(basis, inverse, use, demand)
        prices = inverse.sum(axis=0)
        value, taken = _knapsack(sizes, prices, room)
        bound = max(bound, prices @ demand / max(value[room], 1.0))
        if value[room] <= 1 + 1e-7 or use.sum() - bound <= GAP * bound:
            break
        around = prices + value[room - sizes]
        firsts = [k for k in np.argsort(-around)[:TOGETHER].tolist() if around[k] > 1 + 1e-7]
        pool = np.vstack([pool, *[_pattern(sizes, taken, k, room)[None] for k in firsts]])
    return basis.T.astype(int), _refreshed(basis, inverse, use, demand)[1]


@dataclass
class Plan:
    """Intervals of ranks per class: from ``key`` on, ``each`` items of the class go to every sequence from ``base`` on."""

    key: np.ndarray  # class << 40 | first rank, ascending
    each: np.ndarray
    base: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], room: int) -> Plan:
    """Class (its size in units) -> number of items, into whole patterns that use every item once."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    used: list[tuple[np.ndarray, int]] = []
    if len(sizes):
        patterns, use = fractional(sizes, left.astype(float), room)
        for pattern, times in zip(patterns, np.floor(use + 1e-9).astype(np.int64)):
            held = pattern > 0
            times = min(int(times), int((left[held] // pattern[held]).min()))
            if times > 0:
                used.append((pattern, times))
                left = left - times * pattern
        items = np.repeat(np.arange(len(sizes)), left)  # fewer than the patterns of a basis hold
        for row in best_fit(sizes[items].tolist(), room) if len(items) else []:
            used.append((np.bincount(items[row], minlength=len(sizes)), 1))
    begin, sequence, rows = np.zeros(len(sizes), np.int64), 0, []
    for pattern, times in used:
        for k in np.flatnonzero(pattern).tolist():
            rows.append(((int(sizes[k]) << 40) + int(begin[k]), int(pattern[k]), sequence))
            begin[k] += times * int(pattern[k])
        sequence += times
    rows.sort()
    key, each, base = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    return Plan(key, each, base, sequence)


def pieces(docs: DataFrame, tokenizer: str, width: int, end_id: int, grain: int, id_col: str, text_col: str) -> DataFrame:
    """Every document cut into full sequences and a remainder, each with its class and its place within task and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, met = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(np.frombuffer(words.encode(text.as_py() or ""), words.dtype).astype("<u4"), np.uint32(end_id))
                for start in range(0, len(ids), width):
                    part = ids[start : start + width]
                    kind = -(-len(part) // grain)
                    met[kind] = nth = met.get(kind, -1) + 1
                    out.append((doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(ids), task, kind, nth))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "kind", "nth"]
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack(
    docs: DataFrame,
    tokenizer: str,
    width: int = 2048,
    end_id: int = 1,
    grain: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` per piece, sequences of ``width`` ids at most.

    A null or empty text is its end mark alone. Null doc_ids and repeated rows are packed like any other. An
    empty table gives no rows. ``grain`` rounds lengths up to classes: a finer grain pads less and has a larger program.
    """
    if width % grain:
        raise ValueError("grain must divide width")
    stored = materialize(pieces(docs, tokenizer, width, end_id, grain, id_col, text_col), "pieces")
    counts = materialize(stored.groupBy("kind", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # width / grain rows at most
    plan_ = plan(histogram, width // grain)
    key, each, base = plan_.key, plan_.each, plan_.base
    earlier = Window.partitionBy("kind").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("kind", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = stored.join(offsets, ["kind", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6))
            at = np.searchsorted(key, (kind << 40) + rank, side="right") - 1
            beyond = rank - (key[at] & ((1 << 40) - 1))
            placed = [base[at] + beyond // each[at], -kind, beyond % each[at]]
            columns = [batch.column(i) for i in range(5)] + [pa.array(c, pa.int64()) for c in placed]
            yield pa.record_batch(columns, names=[*kept, "sequence_id", "turn", "slot"])

    schema = ", ".join(f"{n} long" for n in [*kept, "sequence_id", "turn", "slot"])
    placed = ranked.select(*kept, "kind", "rank").mapInArrow(assign, schema)
    before = Window.partitionBy("sequence_id").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    return placed.select(*kept, "sequence_id", offset.alias("offset"))
