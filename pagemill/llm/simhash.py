"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint is the bitwise majority of its shingle hashes. Fingerprints within a radius
are found exactly: of ``radius + 1`` blocks of bits one must be equal, so each distinct fingerprint goes
to one bucket per block. A bucket above ``BUCKET`` rows is split again by the blocks of the remaining bits,
and one still above it into tiles that meet in pairs, so no task holds an unbounded bucket and no pair is lost.

Inside a bucket the fingerprints stand vertically, one bit plane after the other. For each distance in the
sorted order, 64 pairs are compared per machine word: carry-save counters add the planes' differences, and words
whose pairs all exceed the radius (or are linked already) are left out of the remaining planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm.graph import components
from pagemill.plans.stored import materialize

BUCKET = 4096  # rows of a bucket that one task compares at once; above it buckets are split, never cut
FLUSH = 65_536  # rows of sorted buckets that are compared together
PIECE = 65_536  # shingles hashed at a time, so that one long text needs bounded memory
SEED = 42
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def text_fingerprint(text: bytes, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of UTF-8 text; texts without words give 0."""
    words = text.lower().split()  # bytes: lowers A-Z only and splits on ASCII white space only
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    joined = b" ".join(words)
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        first, last = [0], [len(joined)]
    else:
        first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), PIECE):
        spans = zip(first[at : at + PIECE], last[at : at + PIECE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view("<i8")[0])


def _digest(text: Column) -> Column:
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp, digest)`` per row; a null text counts as one without words (0). ``digest`` tells texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [text_fingerprint(t.as_py() or b"", shingle) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "digest"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.withColumn("digest", _digest(F.col("text"))).mapInArrow(run, "doc_id long, fp long, digest long")


# --- buckets ---------------------------------------------------------------------------------------


def _widths(bits: int, parts: int) -> list[int]:
    return [bits // parts + (i < bits % parts) for i in range(parts)]


def _blocks(value: Column, bits: int, parts: int) -> list[tuple[int, int, Column]]:
    """(offset, width, content) of each block of the low ``bits`` of ``value``."""
    out, at = [], 0
    for width in _widths(bits, parts):
        out.append((at, width, F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))))
        at += width
    return out


def _rest(value: Column, at: int, width: int) -> Column:
    """``value`` without the bits of one block, as a ``64 - width`` bit number."""
    low = value.bitwiseAND(F.lit((1 << at) - 1).cast("long"))
    above = at + width
    return low if above >= 64 else low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, above), at))


def _crowded(rows: DataFrame) -> DataFrame | None:
    """Buckets above the bound with their sizes, or None."""
    counts = rows.groupBy("block", "g1", "sub", "g2").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET)
    counts = materialize(counts, "crowded")
    return counts if counts.head(1) else None


def _apart(rows: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["block", "g1", "sub", "g2"]
    return rows.join(crowded.select(keys), keys, "left_anti"), rows.join(crowded, keys)


def buckets(fps: DataFrame, radius: int) -> DataFrame:
    """Distinct ``fp`` -> ``(block, g1, sub, g2, tile, fp)``: any two within the radius share a bucket."""
    parts = radius + 1
    blocks = _blocks(F.col("fp"), 64, parts)
    first = [F.struct(F.lit(i).alias("block"), content.alias("g1")) for i, (_, _, content) in enumerate(blocks)]
    rows = fps.select("fp", F.explode(F.array(*first)).alias("k")).select(
        "k.block", "k.g1", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("g2"), "fp"
    )
    columns = ["block", "g1", "sub", "g2", "tile", "fp"]
    untiled = F.lit(0).cast("long").alias("tile")
    crowded = _crowded(rows)
    if crowded is None:
        return rows.withColumn("tile", untiled).select(columns)
    calm, busy = _apart(rows, crowded)
    again = None
    for i, (at, width, _) in enumerate(blocks):
        inner = _blocks(_rest(F.col("fp"), at, width), 64 - width, parts)
        options = F.array(*[F.struct(F.lit(j).alias("sub"), c.alias("g2")) for j, (_, _, c) in enumerate(inner)])
        again = options if again is None else F.when(F.col("block") == i, options).otherwise(again)
    busy = busy.select("block", "g1", "fp", F.explode(again).alias("k")).select("block", "g1", "k.sub", "k.g2", "fp")
    crowded = _crowded(busy)
    calm = calm.withColumn("tile", untiled).select(columns)
    if crowded is None:
        return calm.union(busy.withColumn("tile", untiled).select(columns))
    second, dense = _apart(busy, crowded)
    calm = calm.union(second.withColumn("tile", untiled).select(columns))
    tiles = F.ceil(F.col("n") / F.lit(BUCKET)).cast("long")
    dense = dense.withColumn("k", tiles).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")))
    other = F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda x: (x != F.col("own")))
    dense = dense.withColumn("o", F.explode(other))
    tile = F.least("own", "o") * F.col("k") + F.greatest("own", "o")
    return calm.union(dense.withColumn("tile", tile).select(columns))


# --- bit-sliced comparison -------------------------------------------------------------------------


def _planes(fps: np.ndarray, words: int) -> np.ndarray:
    """64 rows of packed bits: row b holds bit b of every fingerprint."""
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bitwise comparison of the vertical counters with the radius."""
    above, equal = over.copy(), np.full_like(over, ALL)
    for place in reversed(range(len(counter))):
        if radius >> place & 1:
            equal &= counter[place]
        else:
            above |= equal & counter[place]
            equal &= ~counter[place]
    return above


def bucket_links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal ``groups``, all fingerprints within the radius.

    A forest comes out: a pair whose ends are already connected inside its bucket is not compared.
    """
    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    bounds = np.append(starts, n)
    sizes = np.diff(bounds)
    end = np.repeat(bounds[1:], sizes)
    after = end - 1 - np.arange(n)  # rows that follow in the same bucket
    words = (n + 63) // 64
    reach = int(sizes.max())
    plane = _planes(fps.astype("<u8", copy=False), words + reach // 64 + 2)
    root = np.arange(n)
    active = np.flatnonzero(after >= 1)
    left, right = [], []
    digits = max(radius.bit_length(), 1)
    for gap in range(1, reach):
        active = active[after[active] >= gap]
        apart = active[root[active] != root[active + gap]]
        if not len(apart):
            continue
        mask = np.zeros(words * 64, bool)
        mask[apart] = True
        mask = np.packbits(mask, bitorder="little").view("<u8")
        at = np.flatnonzero(mask)
        alive = mask[at]
        counter, over = [np.zeros_like(alive) for _ in range(digits)], np.zeros_like(alive)
        skip, shift = divmod(gap, 64)
        for p in range(64):
            row = plane[p]
            far = row[at + skip]
            if shift:
                far = (far >> np.uint64(shift)) | (row[at + skip + 1] << np.uint64(64 - shift))
            carry = row[at] ^ far
            for place in counter:
                up = place & carry
                place ^= carry
                carry = up
            over |= carry
            if p >= 11 and p % 4 == 3:
                alive &= ~_exceeds(counter, over, radius)
                keep = alive != 0
                if not keep.all():
                    at, alive, over = at[keep], alive[keep], over[keep]
                    counter = [place[keep] for place in counter]
                    if not len(at):
                        break
        if not len(at):
            continue
        alive &= ~_exceeds(counter, over, radius)
        hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        found = (at[:, None] * 64 + np.arange(64))[hit]
        for i in found.tolist():
            a, b = root[i], root[i + gap]
            if a != b:
                left.append(i)
                right.append(i + gap)
                low = starts[np.searchsorted(starts, i, side="right") - 1]
                part = root[low : end[i]]
                part[part == b] = a
    return fps[left], fps[right]


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct ``fp`` -> ``(a, b)``: links whose components are those of all pairs within ``radius`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(everything: bool):
            nonlocal held, rows
            keys = np.concatenate([k for k, _ in held])
            values = np.concatenate([v for _, v in held])
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = len(values) if everything else (int(change[-1]) if len(change) else 0)
            held = [(keys[cut:], values[cut:])]
            rows = len(values) - cut
            if cut < 2:
                return None
            group = np.zeros(cut, np.int64)
            group[change[change < cut]] = 1
            a, b = bucket_links(np.cumsum(group), values[:cut], radius)
            return pa.record_batch([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            held.append((keys, batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)))
            rows += batch.num_rows
            if rows >= FLUSH and (out := flush(False)) is not None:
                yield out
        if rows and (out := flush(True)) is not None:
            yield out

    keys = ["block", "g1", "sub", "g2", "tile"]
    placed = buckets(fps, radius).repartition(*keys).sortWithinPartitions(*keys, "fp")
    return placed.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing bits.
    Equal fingerprints are one node, so copies cost one row each and are never paired. Null texts, empty texts and texts
    of white space have fingerprint 0 and are linked like any other. Rows with a null doc_id are
    returned and link others; the id of a component without any doc_id is null. Repeated rows come back repeated.
    """
    prints, named = _grouped(docs, radius, shingle, id_col, text_col)
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, radius: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored fingerprints of all rows, and ``(fp, least, root, component_id)`` per distinct fingerprint."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    joined = components(links(nodes.select("fp"), radius)).withColumnsRenamed({"node": "fp"})
    placed = nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, materialize(placed.join(smallest, "root").select("fp", "least", "root", "component_id"), "simhash-named")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One row of ``docs`` (``doc_id``, ``text``, further columns) for every near-duplicate group, with all columns.

    It is the row of the group's smallest doc_id. Where rows of the group share that id, or none has an id, the smallest fingerprint
    and then the smallest digest of the text decide, and of rows that repeat id and text any one stays. Null, empty and blank texts are
    one group, with those within the radius of fingerprint 0. Texts of any length are read whole; an empty table gives no rows.
    """
    prints, named = _grouped(docs, radius, shingle, "doc_id", "text")
    first = named.filter(F.col("least").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root").agg(F.min("fp").alias("fp"), F.min("least").alias("_id"))
    chosen = prints.join(first.select("fp", "_id"), "fp").filter(F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = chosen.groupBy("fp", "_id", "digest").agg(F.count("*").alias("_rows"))
    stay = texts.groupBy("fp").agg(F.min("digest").alias("_digest"), F.min("_id").alias("_id"), F.min_by("_rows", "digest").alias("_rows"))
    stay = materialize(stay.select("_id", "_digest", "_rows"), "simhash-stay")
    columns = [docs[f"`{c}`"] for c in docs.columns]
    own = docs["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (_digest(docs["text"].cast("string")) == stay["_digest"])
    if not stay.filter("_rows > 1").head(1):
        return docs.join(stay, own).select(*columns)
    single, repeated = docs.join(stay.filter("_rows = 1"), own), docs.join(stay.filter("_rows > 1"), own)
    return single.select(*columns).unionByName(repeated.select(*columns).dropDuplicates(["doc_id", "text"]))
