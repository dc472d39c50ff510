"""Two tokenizers over the same text: which tokens overlap, and where both end.

Documents are tokenized in chunks. Within a chunk all documents are walked at once: one NumPy vector of A pointers and one of B pointers, an
entry per lane, where a lane is a run of at most ``LANE`` A tokens of one document (so that a long document needs no more steps than
a short one). A step links the two tokens of every lane, marks a cut where both end at the same byte, moves on whichever ends first (or both),
and drops lanes that are done.

How often an id pair is linked in the whole corpus is counted from one row per chunk and distinct pair, summed by Spark; the sums go
back to the chunks by the same rows. A chunk's documents keep their links as numbers into the chunk's list of pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.plans.stored import materialize

CHUNK = 2_000_000  # characters of a chunk; a longer document is a chunk by itself
LANE = 256  # A tokens of a lane
LOW = (1 << 32) - 1
#: Texts with a longer run of white space go to the slower of A's two encoders: the other's pattern search runs out of stack there.
LONG_BLANK = re.compile(r"\s{1000}")


def _byte_of() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> its byte: printable bytes stand for themselves, the others for 256 and on, in order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Vocabularies:
    """Tokenizer A (byte-level, of the tokenizers library) and B (sentencepiece), the bytes of their tokens, and their ids as text.

    ``a_pattern`` is the pattern by which A cuts words, where its ids are also its merge ranks: tiktoken then finds the same ids
    in a fifth of the time.
    """

    def __init__(self, a_path: str, b_path: str, a_pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters, vocabulary = _byte_of(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.a_bytes[number] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.b_bytes = [self._piece(n) for n in range(self.b.get_piece_size())]
        self.a_quick = None
        if a_pattern:
            from tiktoken import Encoding

            added = {t.content for t in self.a.get_added_tokens_decoder().values()}
            ranks = {self.a_bytes[n]: n for entry, n in vocabulary.items() if entry not in added}
            self.a_quick = Encoding(os.path.basename(a_path), pat_str=a_pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: An id and what follows it: A ids by 2 * id + (group ends), then B ids by 3 * id + (0 inside, 1 at a group's end, 2 at the text's end).
        self.b_codes = 2 * len(self.a_bytes)
        self.written = [f"{n}{c}" for n in range(len(self.a_bytes)) for c in ",|"] + [f"{n}{c}" for n in range(len(self.b_bytes)) for c in (",", ";", "")]

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A and B ids per text; none for null and empty texts, and for texts that either doesn't give back byte by byte."""
        none = np.zeros(0, np.int64)
        a, b = [none] * len(texts), [none] * len(texts)
        for n, text in enumerate(texts):
            if text:
                whole = " " + text
                one, two, data = self._a_ids(whole), self.b.encode(text), whole.encode()
                if b"".join(map(self.a_bytes.__getitem__, one)) == data and b"".join(map(self.b_bytes.__getitem__, two)) == data:
                    a[n], b[n] = np.array(one, np.int64), np.array(two, np.int64)
        return a, b

    def _a_ids(self, text: str) -> list[int]:
        if self.a_quick and not LONG_BLANK.search(text):
            return self.a_quick.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids


_LOADED: dict[tuple, Vocabularies] = {}


def vocabularies(*names: str | None) -> Vocabularies:
    """This worker's pair of tokenizers."""
    if names not in _LOADED:
        _LOADED[names] = Vocabularies(*names)
    return _LOADED[names]


class Aligned(NamedTuple):
    """Documents of a chunk side by side: ids, bounds per document, and links and cuts as token numbers, in text order."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray
    links: tuple[np.ndarray, np.ndarray]
    cuts: tuple[np.ndarray, np.ndarray]
    link_bounds: np.ndarray
    cut_bounds: np.ndarray


def _bounds(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])


def walk(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, lane: int = LANE) -> tuple[tuple, tuple]:
    """Links and cuts between two rows of tokens with these ends; ``a_bounds`` are the documents' first A tokens, then the number of all.

    Every document ends at the same byte in both rows. All lanes of all documents advance together.
    """
    sizes = np.diff(a_bounds)
    lanes = -(-sizes // lane)
    document = np.repeat(np.arange(len(sizes)), lanes)
    within = np.arange(len(document)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    i = a_bounds[document] + within * lane
    stop = np.minimum(i + lane, a_bounds[document + 1])
    starts = np.where(i > 0, a_ends[i - 1], 0)
    j = np.searchsorted(b_ends, starts, side="right")  # the B token that holds the lane's first byte
    links, cuts = [], []
    while len(i):
        links.append((i, j))
        a_end, b_end = a_ends[i], b_ends[j]
        level = a_end == b_end
        cuts.append((i[level], j[level]))
        i, j = i + (a_end <= b_end), j + (b_end <= a_end)
        on = i < stop
        if not on.all():
            i, j, stop = i[on], j[on], stop[on]

    def in_order(steps):
        if not steps:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate([s[side] for s in steps]) for side in (0, 1))
        order = np.argsort(a + b, kind="stable")  # a step moves at least one pointer, so the sum orders the text
        return a[order], b[order]

    return in_order(links), in_order(cuts)


def align(texts: list[str | None], known: Vocabularies) -> Aligned:
    """Links and cuts of a chunk of texts."""
    a, b = known.tokens(texts)
    a_bounds, b_bounds = _bounds([len(x) for x in a]), _bounds([len(x) for x in b])
    a_ids, b_ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    links, cuts = walk(np.cumsum(known.a_sizes[a_ids]), np.cumsum(known.b_sizes[b_ids]), a_bounds)
    bounds = [np.searchsorted(found[0], a_bounds, side="left") for found in (links, cuts)]
    return Aligned(a_ids, b_ids, a_bounds, b_bounds, links, cuts, *bounds)


def _group_codes(found: Aligned, known: Vocabularies) -> np.ndarray:
    """All ids of the chunk as they are written, each with what follows it: a group's A ids, then its B ids."""
    a_cut, b_cut = found.cuts
    a_last, b_last = np.zeros(len(found.a_ids), np.int64), np.zeros(len(found.b_ids), np.int64)
    a_last[a_cut], b_last[b_cut] = 1, 1
    group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    codes = np.empty(len(found.a_ids) + len(found.b_ids), np.int64)
    b_before = np.concatenate([[0], b_cut + 1])  # B tokens before each group
    codes[np.arange(len(found.a_ids)) + b_before[group_a]] = 2 * found.a_ids + a_last
    ends = found.b_bounds[1:][np.diff(found.b_bounds) > 0] - 1
    b_last[ends] = 2
    codes[np.arange(len(found.b_ids)) + a_cut[group_b] + 1] = known.b_codes + 3 * found.b_ids + b_last
    return codes


def _chunks(batches, columns: tuple[str, str], chunk: int) -> Iterator[tuple[list[pa.Array], list]]:
    """Keys (as Arrow arrays) and texts of a chunk at a time."""
    keys, texts, size = [], [], 0
    for batch in batches:
        key, text, start = batch.column(columns[0]), batch.column(columns[1]), 0
        for n in range(batch.num_rows):
            value = text[n].as_py()
            texts.append(value)
            size += len(value or "")
            if size >= chunk:
                yield [*keys, key.slice(start, n + 1 - start)], texts
                keys, texts, size, start = [], [], 0, n + 1
        if start < batch.num_rows:
            keys.append(key.slice(start))
    if texts:
        yield keys, texts


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, chunk long, pairs array<long>, times array<long>"


def _measured(docs: DataFrame, key: str, text: str, tokenizers: tuple, chunk: int) -> DataFrame:
    """A row per document with its digest and links, and one per chunk with the chunk's ``pairs`` and their ``times``."""
    kind = docs.schema[key].dataType.simpleString()

    def read(batches):
        known = vocabularies(*tokenizers)
        for number, (keys, texts) in enumerate(_chunks(batches, ("key", "text"), chunk)):
            found = align(texts, known)
            pairs, place, times = np.unique(found.a_ids[found.links[0]] << 32 | found.b_ids[found.links[1]], return_inverse=True, return_counts=True)
            codes, place = _group_codes(found, known), place.astype(np.uint32)
            shas, links = [], []
            both = found.a_bounds + found.b_bounds
            for n in range(len(texts)):
                start, stop = both[n], both[n + 1]
                written = "".join(map(known.written.__getitem__, codes[start:stop].tolist()))
                shas.append(hashlib.sha256(written.encode()).hexdigest() if stop > start else "")
                links.append(place[found.link_bounds[n] : found.link_bounds[n + 1]].tobytes())
            name = (TaskContext.get().partitionId() << 32) + number
            rows, ids = len(texts), pa.concat_arrays(keys)
            counts = [np.diff(x) for x in (found.a_bounds, found.b_bounds, found.cut_bounds, found.link_bounds)]
            nothing = pa.nulls(rows, pa.list_(pa.int64()))
            columns = [ids, *[pa.array(c) for c in counts], pa.array(shas, pa.string()), pa.array(links, pa.binary()), pa.array([name] * rows), nothing, nothing]
            names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "chunk", "pairs", "times"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int64))) for x in (pairs, times)]
            empty = [pa.nulls(1, c.type) for c in columns[:-3]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([name]), *lists], names=names)

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return materialize(narrow.mapInArrow(read, f"key {kind}, {DIGEST}"), "token-links")


def _weighted(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk and the corpus-wide counts of its pairs -> counts per document."""
    order = np.argsort(right.column("place").to_numpy())
    count = right.column("total").to_numpy()[order]
    best = right.column("best").to_numpy(zero_copy_only=False)[order]
    best_links, sums = [], []
    for links in left.column("links").to_pylist():
        place = np.frombuffer(links, np.uint32)
        best_links.append(int(best[place].sum()))
        sums.append(int(count[place].sum()))
    table = left.drop_columns(["links", "chunk"])
    return table.append_column("n_best", pa.array(best_links, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def measure(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", a_pattern: str | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One row per document: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``n_best`` are the links whose pair is linked as often in the whole table as any pair of its B id (ties all count), ``count_sum`` adds
    their pairs' counts. Null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have zeros and an empty
    digest. Repeated rows and keys, and null keys, are rows like any other and count as often as they stand there. Texts of any length
    are aligned whole; a chunk holds one where it is longer than ``chunk`` characters. Further columns are dropped, whatever their
    names. An empty table gives an empty one.

    A common pair is one row a chunk, so none is hot. The window below is over the pairs of one B id, as many at most as A has ids.
    """
    done = _measured(docs, key, text, (a_path, b_path, a_pattern), chunk)
    listed = F.arrays_zip("pairs", "times")
    pairs = done.filter("pairs IS NOT NULL").select("chunk", F.posexplode(listed).alias("place", "p")).select("chunk", "place", "p.pairs", "p.times")
    totals = pairs.groupBy("pairs").agg(F.sum("times").alias("total"))
    highest = F.max("total").over(Window.partitionBy(F.col("pairs").bitwiseAND(F.lit(LOW))))
    totals = totals.withColumn("best", F.col("total") == highest)
    known = pairs.select("chunk", "place", "pairs").join(totals, "pairs").select(F.col("chunk").alias("home"), "place", "total", "best")
    rows = done.filter("pairs IS NULL").select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "chunk")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = rows.groupBy("chunk").cogroup(known.groupBy("home")).applyInArrow(_weighted, schema)
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def alignments(
    docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", a_pattern: str | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One row per document: ``key``, its ids ``a_ids`` and ``b_ids``, ``links`` and ``cuts`` as (``a``, ``b``) token numbers from 0.

    A cut follows the two tokens it names. Map-only; odd rows as in ``measure``.
    """
    kind = docs.schema[key].dataType.simpleString()
    pair, tokenizers = pa.struct([("a", pa.int64()), ("b", pa.int64())]), (a_path, b_path, a_pattern)

    def read(batches):
        known = vocabularies(*tokenizers)
        for keys, texts in _chunks(batches, ("key", "text"), chunk):
            found = align(texts, known)
            columns = [pa.concat_arrays(keys)]
            for ids, bounds in ((found.a_ids, found.a_bounds), (found.b_ids, found.b_bounds)):
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))
            for (a, b), bounds in ((found.links, found.link_bounds), (found.cuts, found.cut_bounds)):
                document = np.repeat(np.arange(len(texts)), np.diff(bounds))
                parts = [pa.array(a - found.a_bounds[document]), pa.array(b - found.b_bounds[document])]
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(pair))))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "a_ids", "b_ids", "links", "cuts"])

    spans = "array<struct<a: long, b: long>>"
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = narrow.mapInArrow(read, f"key {kind}, a_ids array<long>, b_ids array<long>, links {spans}, cuts {spans}")
    return found.withColumnRenamed("key", key)
