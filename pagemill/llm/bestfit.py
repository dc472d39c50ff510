"""Token-ID output: documents packed into fixed-width id matrices by best-fit decreasing.

Map-only. Each task tokenizes its documents, cuts overlong ones into full rows and a remainder, and packs its pieces in
runs of bounded size; nothing is shuffled. Badly filled rows of a run are dissolved and their pieces join the next run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.tokens import encoder

RUN = 16_384  # pieces that are packed together
FULL = 0.97  # rows of a run below this share of the width are packed again with the next run
SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, doc_starts array<long>"
)


class CapacityTree:
    """Segment tree over room left (0..width): which amounts some open row has, smallest sufficient first."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.used = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.used[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """An open row with the least room of at least ``need``, removed from the tree."""
        used, at = self.used, need + self.leaves
        if not used[at]:
            while at > 1 and (at & 1 or not used[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if used[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            used[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; longest pieces first, equal lengths in their order."""
    tree, rows = CapacityTree(width), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        spot = tree.take(lengths[piece])
        if spot is None:
            spot = width, len(rows)
            rows.append([])
        rows[spot[1]].append(piece)
        if spot[0] > lengths[piece]:
            tree.add(spot[0] - lengths[piece], spot[1])
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    width: int = 2048,
    end_id: int = 49_407,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``width`` token ids over all documents, one document end mark after each document.

    ``input_ids`` holds ``width`` little-endian unsigned ids (16 bits if the vocabulary allows, else 32), padded with
    ``pad_id``; ``cu_seqlens`` the cumulative segment lengths from 0; ``position_ids`` 16-bit positions (32-bit for a width
    over 65,536) that restart at 0 in every segment; ``doc_ids`` and ``doc_starts`` say where each segment comes from.
    Each id of a document lies in exactly one segment. A null or empty text is its end mark alone; null doc_ids and
    repeated rows are packed like any other. An empty table gives no rows. ``sequence_id`` is unique, not gapless.
    """
    if width < 1:
        raise ValueError("width must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        dtype = words.dtype if max(end_id, pad_id) < 65_536 else np.dtype("<u4")
        position_type = np.dtype("<u2" if width <= 65_536 else "<u4")
        number = TaskContext.get().partitionId() << 40
        mark, step = np.array([end_id], dtype).tobytes(), dtype.itemsize
        ramp = np.arange(width, dtype=position_type).tobytes()
        held: list[tuple] = []  # doc_id, start, ids as bytes

        def emit(rows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for at in range(0, len(rows), 256):
                out = []
                for row in rows[at : at + 256]:
                    sizes = [len(ids) // step for _, _, ids in row]
                    total = sum(sizes)
                    pad = np.full(width - total, pad_id, dtype).tobytes()
                    places = [ramp[: n * position_type.itemsize] for n in sizes] + [bytes((width - total) * position_type.itemsize)]
                    cumulative = [0, *np.cumsum(sizes).tolist()]
                    ids = b"".join([x for _, _, x in row] + [pad])
                    out.append((number, total, len(row), ids, cumulative, b"".join(places), [d for d, _, _ in row], [s for _, s, _ in row]))
                    number += 1
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = [part.split()[0] for part in SCHEMA.split(", ")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            sizes = [len(ids) // step for _, _, ids in held]
            rows = best_fit(sizes, width)
            loose = [] if last else [row for row in rows if sum(sizes[i] for i in row) < FULL * width]
            if sum(map(len, loose)) > RUN // 2:
                loose = []
            again = {i for row in loose for i in row}
            yield from emit([[held[i] for i in row] for row in rows if row[0] not in again])
            held = [held[i] for i in sorted(again)]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.encode(text.as_py() or "")
                if dtype != words.dtype:
                    ids = np.frombuffer(ids, words.dtype).astype(dtype).tobytes()
                ids += mark
                full = len(ids) // step // width * width
                whole = [(doc_id, s, ids[s * step : (s + width) * step]) for s in range(0, full, width)]
                yield from emit([[piece] for piece in whole])
                if len(ids) > full * step:
                    held.append((doc_id, full, ids[full * step :]))
                if len(held) >= RUN:
                    yield from flush(False)
        if held:
            yield from flush(True)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, SCHEMA)
