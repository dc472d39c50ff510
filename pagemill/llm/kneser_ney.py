"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and looked up in memory-mapped hash arrays.

Words are numbered first: a count of all words gives each a number, small for frequent ones, so that grams travel and are stored as numbers of few
bytes, not as hashes or with a dictionary in every packet. Then tasks count the n-grams of their texts, one per token (before a text stand marks), and send
them packed to parts chosen by the last word but one; a very frequent word is spread over several parts by what follows it. A gram and its ending (without
the first word) share a part, which writes them as a trie read backwards to the shared folder: a pair, the words before it, the words before those. How many
different words precede an ending, which is its count one level below, is how many children it has. What grams tell about their beginnings, as contexts (how much
follows, and how many words once, twice and more often), is summed up in the part and goes to the beginnings' parts by another shuffle, to be written beside
them; what they tell about words likewise. A part stands for ``PART_BYTES`` of text, so there are more parts for more text and none grows. Nothing but a few
short rows per part reach the driver. Scoring maps the arrays: workers of a machine share their pages and read only those they touch.

Words are told apart by 48-bit hashes, grams exactly by their words' numbers. Files are written beside their place and renamed, so a repeated task leaves the
same file. The texts are read three times, to be numbered, counted and scored; they have to be the same each time.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.llm.hyperlang import fold
from pagemill.plans.stored import fresh_path

BEGIN, END = 1, 0  # hashes of the marks before and after a text
NONE, UNKNOWN = 0, 1 << 47  # numbers: of what stands before the mark that opens a text, and of words never learnt
FLUSH = 1 << 22  # tokens a task counts before it sends its pairs on
LOOKUP = 1 << 20  # tokens scored together
SHARES = 32  # a word that is more than one of so many bytes of a part's text is spread over several parts
REMEMBERED = 400_000  # words looked up at once
TEXT_BYTES = 16 << 20  # bytes of texts split together, a text at least
ORDER = 3  # words of the longest grams
PART_BYTES = 16 << 20  # bytes of text that a part of a level stands for
TOPS = 1 << 16  # ranges of a file of sorted keys
SLOTS = 1 << 40  # slots of a level: its parts
FOLLOWED = 4  # as a context: sum of the counts that follow, words that follow once, twice, more often
WORD_FIELDS = 2 + FOLLOWED  # occurrences, different words before, and as a context


def _hashes(words: list[bytes]) -> np.ndarray:
    """48-bit hashes of words, none of them a mark's."""
    out = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & np.uint64(0xFFFFFFFFFFFF)
    return np.where(out > 1, out, out + np.uint64(2))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about ``TEXT_BYTES`` each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    for a, b in _ranges(ends // TEXT_BYTES):
        yield texts.slice(a, b - a)


def word_places(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end as places of words, the hashes at those places, and the tokens of each text; null texts are empty ones.

    Before a text stand ``order`` - 2 times place 0, of ``NONE`` (which has no hash), and place 1, of ``BEGIN``; behind it stands place 2, of ``END``.
    A-Z are lowered, and words are what ASCII white space leaves.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded, ends = words.flatten().dictionary_encode(), words.offsets.to_numpy().astype(np.int64)
    known, place, ends = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy(), ends - ends[0]
    blank = pc.index(coded.dictionary, "").as_py()  # beside white space at a text's borders
    if blank >= 0:
        keep = place != blank
        place, ends = place[keep], np.concatenate(([0], np.cumsum(keep)))[ends]
    n, before = np.diff(ends), order * np.arange(len(ends) - 1)
    out = np.zeros(len(place) + order * len(n), np.uint32)
    out[ends[:-1] + before + order - 2] = 1
    out[ends[1:] + before + order - 1] = 2
    out[np.arange(len(place)) + np.repeat(before + order - 1, n)] = place + 3
    return out, np.concatenate((np.array([BEGIN, BEGIN, END], np.uint64), _hashes(known))), n + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_part(before: np.ndarray, word: np.ndarray, parts: int, hot: np.ndarray | None = None) -> np.ndarray:
    """Part of grams, by their last word but one and, if that is among the ``hot`` ones (rows of number and spread, ascending), by their last."""
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot[:, 0], before), len(hot) - 1)
        spread = np.where(hot[at, 0] == before, hot[at, 1], np.uint64(1))
        before = before * np.uint64(0x9E3779B97F4A7C15) + _mixed(word * np.uint64(0x9E3779B97F4A7C15)) % spread
    else:
        before = before * np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(before) % np.uint64(parts)).astype(np.int64)


def word_part(word: np.ndarray, parts: int) -> np.ndarray:
    """Part of words by their hash; of numbered words it is their number less one modulo the parts."""
    return (_mixed(word) % np.uint64(parts)).astype(np.int64)


def _keyed(columns: list[np.ndarray]) -> tuple[np.ndarray, list[tuple]]:
    """One number per row, which sorts as the columns do, and the steps by which ``_columns`` gets them back."""
    bits = lambda x: int(x.max(initial=0)).bit_length()
    key, steps = columns[0].astype(np.uint64), []
    for column in columns[1:]:
        column, known, own = column.astype(np.uint64), None, None
        if bits(key) + bits(column) > 63:
            known, key = np.unique(key, return_inverse=True)
            key = key.astype(np.uint64)
        if bits(key) + bits(column) > 63:
            own, column = np.unique(column, return_inverse=True)
            column = column.astype(np.uint64)
        steps.append((bits(column), known, own))
        key = key << np.uint64(steps[-1][0]) | column
    return key, steps


def _columns(key: np.ndarray, steps: list[tuple]) -> list[np.ndarray]:
    out = []
    for bits, known, own in reversed(steps):
        column, key = key & np.uint64((1 << bits) - 1), key >> np.uint64(bits)
        out.append(column if own is None else own[column])
        key = key if known is None else known[key]
    return [key, *out[::-1]]


def _firsts(*ordered: np.ndarray) -> np.ndarray:
    """Places where one of the columns differs from the row before."""
    new = np.zeros(len(ordered[0]), bool)
    new[:1] = True
    for column in ordered:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


# --- files -----------------------------------------------------------------------------------------


def _posix(path: str) -> str | None:
    """The path itself where the shared folder is a mounted file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them all; the file's size tells which."""
    most = int(counts.max(initial=0))
    return counts.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max))


def _joined(blocks: list[bytes]) -> bytes:
    """Blocks behind their number and lengths."""
    return np.array([len(blocks), *map(len, blocks)], "<u8").tobytes() + b"".join(blocks)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, "<u8", n, 8).astype(np.int64))
    starts = [8 * (n + 1), *ends[:-1].tolist()]
    return [data[a:b] for a, b in zip(starts, ends.tolist())]


def _squeezed(counts: np.ndarray) -> bytes:
    """A table of counts column by column, in the width that holds them all, compressed."""
    narrow = _narrow(np.ascontiguousarray(counts.T))
    return bytes([narrow.itemsize]) + zstandard.compress(narrow.tobytes(), 1)


def _stretched(data: bytes, fields: int) -> np.ndarray:
    counts = np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[0]}")
    return counts.reshape(fields, len(counts) // fields).T.astype(np.float64)


def _planes(values: np.ndarray) -> list[bytes]:
    """Whole numbers by their bytes, as many as the largest needs, compressed."""
    used = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    return [zstandard.compress(np.ascontiguousarray(planes[:, i]).tobytes(), 1) for i in range(used)]


def _flat(planes: list[bytes]) -> np.ndarray:
    whole = [np.frombuffer(zstandard.decompress(p), np.uint8) for p in planes]
    out = np.zeros((len(whole[0]), 8), np.uint8)
    for i, plane in enumerate(whole):
        out[:, i] = plane
    return out.view("<u8").ravel()


def _packed_words(words: np.ndarray) -> list[bytes]:
    """Words (rows, columns): the last column but one as differences from row to row, the last one likewise while that stays, the others as they are."""
    columns = [*words.T.astype(np.uint64)]
    steps = np.diff(columns[max(0, len(columns) - 2)], prepend=np.uint64(0))
    if len(columns) > 1:
        new = steps != 0
        new[:1] = True
        columns[-1] = np.where(new, columns[-1], np.diff(columns[-1], prepend=np.uint64(0)))
    columns[max(0, len(columns) - 2)] = steps
    return [_joined(_planes(c)) for c in columns]


def _unpacked_words(blocks: list[bytes], columns: int) -> np.ndarray:
    out = [_flat(_split(block)) for block in blocks]
    steps = out[max(0, columns - 2)]
    if columns > 1 and len(steps):
        new = steps != 0
        new[0] = True
        sums, first = np.cumsum(out[-1]), np.flatnonzero(new)
        out[-1] = sums - np.repeat(sums[first] - out[-1][first], np.diff(first, append=len(steps)))
    out[max(0, columns - 2)] = np.cumsum(steps)
    return np.column_stack(out)


def _write(path: str, arrays: list[np.ndarray]) -> None:
    local = _posix(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        beside = f"{local}.{uuid.uuid4().hex}"
        with open(beside, "wb") as out:
            for array in arrays:
                array.tofile(out)
        os.replace(beside, local)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    beside = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        for array in arrays:
            out.write(array.tobytes())
    store.move(beside, name)


def _map(path: str) -> np.ndarray:
    """Bytes of a file, memory-mapped; from a store that cannot be mapped, of a copy that has no name any more."""
    local = _posix(path)
    if not local:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        handle, local = tempfile.mkstemp()
        with store.open_input_stream(name) as source, os.fdopen(handle, "wb") as out:
            while block := source.read(1 << 22):
                out.write(block)
    whole = np.memmap(local, np.uint8, "r")
    if not _posix(path):
        os.unlink(local)
    return whole


def _write_arrays(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays of unsigned numbers behind their number, widths and lengths; each starts at a multiple of eight bytes."""
    head = np.array([len(arrays), *[n for a in arrays for n in (a.itemsize, len(a))]], "<u8")
    _write(path, [np.frombuffer(a.tobytes() + bytes(-a.nbytes % 8), np.uint8) for a in [head, *arrays]])


def _read_arrays(path: str) -> list[np.ndarray]:
    whole = _map(path)
    n = int(np.frombuffer(whole[:8], "<u8")[0])
    head = np.frombuffer(whole[8 : 8 + 16 * n], "<u8").reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for width, length in head:
        out.append(np.frombuffer(whole[at : at + width * length], f"<u{width}"))
        at += -(-width * length // 8) * 8
    return out


def _split_width(numbers: np.ndarray) -> list[np.ndarray]:
    """Numbers as their last 16 bits and what is before those, in the width that needs."""
    high = (numbers >> np.uint64(16)).astype("<u8")
    most = int(high.max(initial=0))
    return [numbers.astype("<u2"), np.zeros(0, "<u1") if not most else _narrow(high) if most < 0xFFFF else high]


class Numbers:
    """Numbers kept by ``_split_width``."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = low, high

    def at(self, place: np.ndarray) -> np.ndarray:
        if not len(self.high):
            return self.low[place]
        kind = np.uint32 if self.high.itemsize < 8 else np.uint64
        out = self.high[place].astype(kind)
        out <<= kind(16)
        out |= self.low[place]
        return out

    def place(self, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of numbers in their ascending ranges, and whether they are there: all ranges are halved at once."""
        if self.high.itemsize < 8:
            wanted = np.minimum(wanted, 0xFFFFFFFF).astype(np.uint32)  # above all numbers of this width
        return _halved(self.at, wanted, low, high)


def _halved(at: Callable, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, found = low.astype(np.int64), np.zeros(len(low), bool)
    some = row = np.flatnonzero(low < high)
    base, want = out[row], wanted[row]
    size = high[row].astype(np.int64) - base
    while len(row):
        going = size > 1
        if 2 * np.count_nonzero(going) < len(row):
            out[row] = base
            row, base, want, size = row[going], base[going], want[going], size[going]
        half = size >> 1
        middle = base + half
        base = np.where(at(middle) <= want, middle, base)
        size -= half
    found[some] = at(out[some]) == wanted[some]
    return out, found


class Counted:
    """Rows of counts. Where they repeat, each different row is kept once, and every row has a code of a byte; 255 refers to a list of wider ones."""

    def __init__(self, arrays: list[np.ndarray], turn: Callable | None = None) -> None:
        """``turn`` is done to the rows asked for, beforehand where few differ."""
        (self.rows, self.fields, plain), self.codes, self.exceptions, self.wide, known = arrays[0].tolist(), *arrays[1:]
        self.known, self.plain, self.turn = known.reshape(-1, self.fields), bool(plain), turn or (lambda x: x)
        if turn and not plain and len(self.known) <= 1 << 16:
            self.known, self.turn = turn(self.known.astype(np.int64)), None

    def _turned(self, at: np.ndarray) -> np.ndarray:
        return self.turn(self.known[at].astype(np.int64)) if self.turn else self.known[at]

    @staticmethod
    def arrays(counts: np.ndarray) -> list[np.ndarray]:
        counts, none = np.ascontiguousarray(counts).astype("<u8"), np.zeros(0, "<u1")
        key, steps = _keyed([*counts.T])
        distinct, number, times = np.unique(key, return_inverse=True, return_counts=True)
        head = lambda plain: np.array([*counts.shape, plain], "<u8")
        if 4 * len(distinct) > len(key):
            return [head(1), none, none, none, _narrow(counts).ravel()]
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(distinct), np.uint64)
        rank[order] = np.arange(len(distinct), dtype=np.uint64)
        codes, known = rank[number], _narrow(np.column_stack(_columns(distinct[order], steps))).ravel()
        beyond = np.flatnonzero(codes >= 255)
        if 8 * len(beyond) > len(key):  # with so many beyond a byte the widest code is beyond it too
            return [head(0), _narrow(codes), none, none, known]
        return [head(0), np.minimum(codes, 255).astype("<u1"), _narrow(beyond), _narrow(codes[beyond]), known]

    def at(self, place: np.ndarray) -> np.ndarray:
        if self.plain:
            return self._turned(place)
        codes = self.codes[place]
        if self.codes.itemsize == 1:
            beyond = np.flatnonzero(codes == 255)
            if len(beyond):
                codes = codes.astype(np.int64)
                codes[beyond] = self.wide[np.searchsorted(self.exceptions, place[beyond].astype(self.exceptions.dtype))]
        return self._turned(codes)


class Table:
    """A file of counts by sorted keys.

    Of a key the first 16 bits lead to a range of the file, which holds the other 48: the middle 32, then the last 16.
    """

    def __init__(self, path: str) -> None:
        self.starts, self.middle, self.last, *counts = _read_arrays(path)
        self.counted = Counted(counts)
        self.rows, self.fields = self.counted.rows, self.counted.fields

    @property
    def values(self) -> np.ndarray:
        return self.counted.at(np.arange(self.rows))

    @staticmethod
    def write(path: str, keys: np.ndarray, counts: np.ndarray) -> None:
        starts = np.searchsorted(keys >> np.uint64(48), np.arange(TOPS + 1, dtype=np.uint64))
        _write_arrays(path, [_narrow(starts), (keys >> np.uint64(16)).astype("<u4"), keys.astype("<u2"), *Counted.arrays(counts)])

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys, and whether they are there."""
        top = (keys >> np.uint64(48)).astype(np.int64)
        return _halved(self._rest, keys & np.uint64(0xFFFFFFFFFFFF), self.starts[top].astype(np.int64), self.starts[top + 1].astype(np.int64))

    def _rest(self, at: np.ndarray) -> np.ndarray:
        return self.middle[at].astype(np.uint64) << np.uint64(16) | self.last[at].astype(np.uint64)

    def keys(self) -> np.ndarray:
        return self._rest(np.arange(self.rows)) | np.repeat(np.arange(TOPS, dtype=np.uint64), np.diff(self.starts.astype(np.int64))) << np.uint64(48)


class Trie:
    """A part's grams, read backwards from the last word but one: words, the words that follow them (pairs), the words before those, and so on.

    ``columns`` of grams stand in that order: last word but one, last word, last but two, and so on to the first. A pair's count, and that of any gram
    shorter than the longest, is the number of its children, or, where a text begins and its child is ``NONE``, that child's count.
    """

    def __init__(self, path: str) -> None:
        first, *rest = _read_arrays(path)
        self.order = int(first[0])
        self.firsts, self.starts, self.labels = rest[0], [rest[1]], []
        for level in range(2, self.order + 1):
            at = 2 + 3 * (level - 2)
            self.labels.append(Numbers(rest[at], rest[at + 1]))
            if level < self.order:
                self.starts.append(rest[at + 2])
        self.counted = Counted(rest[2 + 3 * (self.order - 1) - 1 :])

    @staticmethod
    def write(path: str, columns: list[np.ndarray], starts: list[np.ndarray], counts: np.ndarray) -> None:
        """Distinct grams in order; per level, from words on, where its items begin among the grams."""
        arrays = [np.array([len(columns)], "<u8"), _narrow(columns[0][starts[0]])]
        for level, here in enumerate(starts):
            if level:
                arrays += _split_width(columns[level][here])
            if level + 1 < len(columns):
                arrays.append(_narrow(np.append(np.searchsorted(starts[level + 1], here), len(starts[level + 1]))))
        _write_arrays(path, [*arrays, *Counted.arrays(counts[:, None])])

    def find(self, columns: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per level from pairs on: the level, and of the grams that are there their rows and places."""
        at = np.searchsorted(self.firsts, columns[0])
        row = np.flatnonzero(at < len(self.firsts))
        row = row[self.firsts[at[row]] == columns[0][row]]
        place = at[row]
        for level, (starts, labels, column) in enumerate(zip(self.starts, self.labels, columns[1:]), 2):
            place, found = labels.place(column[row], starts[place], starts[place + 1])
            row, place = row[found], place[found]
            yield level, row, place

    def size(self, level: int) -> int:
        return len(self.labels[level - 2].low)

    def counts(self, level: int, place: np.ndarray) -> np.ndarray:
        if level == self.order:
            return self.counted.at(place)[:, 0]
        starts = self.starts[level - 1]
        first = starts[place].astype(np.int64)
        out = starts[place + 1] - first
        opens = np.flatnonzero(out == 1)
        opens = opens[self.labels[level - 1].at(first[opens]) == NONE]
        if len(opens):
            out[opens] = self.counts(level + 1, first[opens])
        return out


# --- counting --------------------------------------------------------------------------------------


CONTEXTS, WORDS, SUMS = range(3)  # kinds of packed rows behind the first shuffle; before it, the words of a gram
PACKED = "slot long, kind int, data binary"


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int32(), pa.binary()])], names=["slot", "kind", "data"])


def _ranges(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values."""
    bounds = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)])).tolist()
    return zip(bounds[:-1], bounds[1:])


def _packed(slot: np.ndarray, kind: int, words: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Packed rows of grams (or words) with a table of counts, a row per slot; sorted, so that what is alike is near."""
    order = np.argsort(_keyed([slot - slot.min(initial=1 << 62), *words.T[-2:], *words.T[:-2]])[0])
    return _packed_in_order(slot[order], kind, words[order], counts[order])


def _packed_in_order(slot: np.ndarray, kind: int, words: np.ndarray, counts: np.ndarray) -> list[tuple]:
    return [(int(slot[a]), kind, _joined([_squeezed(counts[a:b]), *_packed_words(words[a:b])])) for a, b in _ranges(slot)]


def _unpacked(data: bytes, columns: int, fields: int) -> tuple[np.ndarray, np.ndarray]:
    counts, *words = _split(data)
    return _unpacked_words(words, columns), _stretched(counts, fields)


def _summed(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their rows, and one place of each."""
    distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.stack([np.bincount(where, table[:, i], len(distinct)) for i in range(table.shape[1])], axis=1) if len(distinct) else np.zeros((0, table.shape[1]))
    return distinct, sums.astype(np.int64), first


def _chunks(batches: Iterator[pa.RecordBatch], order: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts as ``word_places`` and hashes, which may repeat; about ``FLUSH`` tokens at a time."""
    held, hashes, size, first = [], [], 0, 0
    for batch in batches:
        for texts in _slices(batch.column(0)):
            places, words, _ = word_places(texts, order)
            places[places > 2] += np.uint32(first)
            held.append(places)
            hashes.append(words[3:] if hashes else words)
            size, first = size + len(places), first + len(words) - 3
            if size >= FLUSH:
                whole = np.concatenate(held), np.concatenate(hashes)
                held, hashes, size, first = [], [], 0, 0
                yield whole
                del whole
    if held:
        yield np.concatenate(held), np.concatenate(hashes)


def _count_words(parts: int):
    """Texts -> packed counts of words, texts counting as occurrences of the mark before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, hashes in _chunks(batches):
            word, at = np.unique(hashes, return_inverse=True)
            times = np.bincount(at, np.bincount(places, minlength=len(hashes)))
            yield from _rows(_packed(word_part(word, parts), WORDS, word[:, None], times[:, None]))

    return run


def _number_words(folder: str, parts: int, share: int):
    """Packed counts of words -> a file of their ranks, most frequent first, per part; rows of the parts, and of the words that are to be spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_slot(batches):
            tables = [_unpacked(data, 1, 1) for _, data in rows]
            key, times, _ = _summed(np.concatenate([w[:, 0] for w, _ in tables]), np.concatenate([t for _, t in tables]))
            order = np.argsort(-times[:, 0], kind="stable")
            rank = np.empty(len(key), np.int64)
            rank[order] = np.arange(len(key))
            Table.write(f"{folder}/words-{part}", key, rank[:, None])
            spread = -(-times[order, 0] // share)
            hot = np.flatnonzero(spread > 1)
            found = [[part] * (len(hot) + 1), [NONE, *(1 + hot * parts + part).tolist()], [0, *spread[hot].tolist()]]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in found], names=["part", "word", "spread"])

    return run


@dataclass
class Numbering:
    """Where the words' numbers are: the number of a word is one more than its rank in its part, times the parts, plus the part."""

    folder: str
    parts: int
    held: set[int]  # parts with words
    hot: np.ndarray  # number and spread of words that are too frequent for one part

    def numbers(self, hashes: np.ndarray, tables: dict[int, Table]) -> np.ndarray:
        """Numbers of words by hash; ``tables`` keeps what was mapped before."""
        out, part = np.full(len(hashes), UNKNOWN, np.uint64), word_part(hashes, self.parts)
        order = np.argsort(part, kind="stable")
        for a, b in _ranges(part[order]):
            at, number = order[a:b], int(part[order[a]])
            if number in self.held:
                if number not in tables:
                    tables[number] = Table(f"{self.folder}/words-{number}")
                table = tables[number]
                place, hit = table.place(hashes[at])
                out[at[hit]] = 1 + table.counted.at(place[hit])[:, 0].astype(np.uint64) * np.uint64(self.parts) + np.uint64(number)
        return out


def _count(order: int, numbering: Numbering):
    """Texts -> packed gram counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for places, hashes in _chunks(batches, order):
            number = numbering.numbers(hashes, tables)
            number[0] = NONE
            if (number == UNKNOWN).any():
                raise RuntimeError("the texts hold words that were not there when words were numbered")
            known, rank = np.unique(number, return_inverse=True)
            word, at = rank.astype(np.uint32)[places], np.flatnonzero(places > 1)
            del places, hashes, number, rank
            key, steps = _keyed([word[at - 1], word[at], *[word[at - i] for i in range(2, order)]])
            del word, at
            key.sort()
            first = _firsts(key)
            times, key = np.diff(first, append=len(key)), key[first]
            del first
            columns = _columns(key, steps)
            del key, steps
            slot = gram_part(known[columns[0]], known[columns[1]], numbering.parts, numbering.hot)
            near = np.argsort(slot.astype(np.uint16) if numbering.parts < 1 << 16 else slot, kind="stable")
            slot = slot[near]
            for a, b in _ranges(slot):
                own = near[a:b]
                words = known[np.column_stack([c[own] for c in (*columns[:1:-1], *columns[:2])])]
                yield from _rows(_packed_in_order(slot[a:b], order, words, times[own][:, None]))

    return run


def _by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted slots, gathered: (slot, rows without the slot)."""
    slot, rows = None, []
    for batch in batches:
        for now, kind, data in zip(*[c.to_pylist() for c in batch.columns]):
            if slot is not None and now != slot:
                yield slot, rows
                rows = []
            slot = now
            rows.append((kind, data))
    if slot is not None:
        yield slot, rows


def _sums_row(level: int, part: int, n: int, counts: np.ndarray, tokens: int = 0, known: int = 0) -> tuple:
    ones = [int((counts == i).sum()) for i in range(1, 5)]
    return (-1 - level * SLOTS - part, SUMS, np.array([level, part, n, *ones, tokens, known], "<u8").tobytes())


def _followed(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct contexts, and what follows them: the sum of the counts, how many are one, two, more."""
    key, steps = _keyed(columns)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = _firsts(key)
    if not len(first):
        return columns, np.zeros((0, FOLLOWED), np.int64)
    return _columns(key[first], steps), np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (count, count == 1, count == 2, count > 2)], axis=1)


def _add_grams(order: int, folder: str, parts: int, hot: np.ndarray | None = None):
    """Packed counts of the parts -> a trie of all levels each, and what the grams tell contexts and words."""

    def told(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(data, order, 1) for _, data in rows]
        rows.clear()
        words, times = np.concatenate([w for w, _ in held]), np.concatenate([c[:, 0] for _, c in held])
        held.clear()
        key, steps = _keyed([words[:, -2], words[:, -1], *words.T[-3::-1]])
        del words
        grams = np.sort(key)
        first = _firsts(grams)
        grams, count = grams[first], np.diff(first, append=len(grams))
        more = np.flatnonzero(times != 1)
        count = count + np.bincount(np.searchsorted(grams, key[more]), times[more] - 1, len(grams)).astype(np.int64)
        columns = _columns(grams, steps)
        del key, grams
        starts = [_firsts(*columns[: level + 1]) for level in range(order - 1)] + [np.arange(len(count))]
        Trie.write(f"{folder}/grams-{part}", columns, starts, count)
        token, as_token = _followed([columns[1]], count)
        for level in range(order, 1, -1):
            here, label = starts[level - 1], columns[level - 1][starts[level - 1]]
            if level < order:
                child = np.searchsorted(starts[level], here)
                opens = columns[level][here] == NONE
                count = np.where(opens, count[child], np.diff(child, append=len(starts[level])))
            real = np.flatnonzero(label != NONE)  # not reaching back beyond a text's beginning
            yield from _rows([_sums_row(level, part, len(real), count[real])])
            if level > 2:
                # Its beginning, in the order of columns: last word but two, last but one, and so on.
                own = here[real]
                begins, sums = _followed([columns[2][own], columns[0][own], *[c[own] for c in columns[3:level]]], count[real])
                slot = (level - 1) * SLOTS + gram_part(begins[0], begins[1], parts, hot)
                yield from _rows(_packed(slot, CONTEXTS, np.column_stack([*begins[:1:-1], begins[0], begins[1]]), sums))
        before, after = columns[0][starts[1]], columns[1][starts[1]]
        (ending,), as_word = _followed([after], np.ones(len(after), np.int64))
        (context,), as_context = _followed([before], count)
        word = np.unique(np.concatenate((token[0], context)))
        table = np.zeros((len(word), WORD_FIELDS), np.int64)
        table[np.searchsorted(word, token[0]), 0] = as_token[:, 0]
        table[np.searchsorted(word, ending), 1] = as_word[:, 0]
        table[np.searchsorted(word, context), 2:] = as_context
        yield from _rows(_packed(SLOTS + ((word - np.uint64(1)) % np.uint64(parts)).astype(np.int64), WORDS, word[:, None], table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_slot(batches):
            yield from told(part, rows)

    return run


FACTS = ["level", "part", "rows", "n1", "n2", "n3", "n4", "tokens", "words"]


def _add_contexts(folder: str):
    """What grams tell about contexts and words -> a file beside the context's grams, or the part's word file; and the rows of sums.

    Every context is a gram of its part, so the file has a row per gram and needs no keys. Its row of sums has level -1 - the contexts'.
    """

    def followed(level: int, part: int, rows: list[tuple]) -> list[int]:
        tables = [_unpacked(data, level, FOLLOWED) for _, data in rows]
        words, told = np.concatenate([w for w, _ in tables]), np.concatenate([t for _, t in tables]).astype(np.int64)
        key, steps = _keyed([words[:, -2], words[:, -1], *words.T[-3::-1]])
        order = np.argsort(key)
        first = _firsts(key[order])
        sums = np.add.reduceat(told[order], first, axis=0)
        grams = Trie(f"{folder}/grams-{part}")
        out = np.zeros((grams.size(level), FOLLOWED), np.int64)
        for at, row, place in grams.find(_columns(key[order[first]], steps)):
            if at == level:
                out[place] = sums[row]
        _write_arrays(f"{folder}/followed{level}-{part}", Counted.arrays(out))
        return [-1 - level, part, len(out), *[0] * 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in _by_slot(batches):
            if slot < 0:
                found = [np.frombuffer(row[-1], "<u8").tolist() for row in rows]
            elif slot // SLOTS > 1:
                found = [followed(slot // SLOTS, slot % SLOTS, rows)]
            else:
                tables = [_unpacked(data, 1, WORD_FIELDS) for _, data in rows]
                key, total, _ = _summed(np.concatenate([w[:, 0] for w, _ in tables]), np.concatenate([t for _, t in tables]))
                Table.write(f"{folder}/grams1-{slot % SLOTS}", key, total)
                sums = _sums_row(1, slot % SLOTS, len(key), total[:, 1], int(total[:, 0].sum()), int((total[:, 0] > 0).sum()))
                found = [np.frombuffer(sums[-1], "<u8").tolist()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=FACTS)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and more, from the numbers of items seen one to four times."""
    out = np.array([0.0, 0.5, 0.75, 0.75])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for i in range(1, 4):
            if n[i - 1] and n[i]:
                out[i] = min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05)
    return out


@dataclass
class Model:
    """Where the arrays are and the few numbers that hold for all; a plain value that travels to the workers."""

    folder: str
    order: int
    parts: int
    held: dict[int, set[int]]  # level -> parts with grams; -1 - level -> parts with contexts among them
    tokens: int  # N
    words: int  # V
    pairs: int
    discounts: dict[int, np.ndarray]  # level -> what is taken from counts 0, 1, 2 and more
    left_over: float  # mass the lowest level takes from words and spreads evenly
    numbering: Numbering

    def unseen(self) -> float:
        return self.left_over / (self.words + 1)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Counts all texts of ``docs``. A null text is an empty one, which is its end mark; repeated rows count again."""
    if order < 2:
        raise ValueError("a model has two words or more")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    folder = fresh_path(spark, "kneser-ney")
    packed = texts.mapInArrow(_count_words(parts), PACKED).repartition("slot").sortWithinPartitions("slot")
    share = max(1, size // (parts * SHARES))
    ranked = packed.mapInArrow(_number_words(folder, parts, share), "part long, word long, spread long").collect()  # a row per part and spread word
    hot = sorted((r["word"], r["spread"]) for r in ranked if r["word"] != NONE)
    numbering = Numbering(folder, parts, {r["part"] for r in ranked}, np.array(hot, np.uint64).reshape(-1, 2))
    counted = texts.mapInArrow(_count(order, numbering), PACKED).repartition("slot").sortWithinPartitions("slot")
    told = counted.mapInArrow(_add_grams(order, folder, parts, numbering.hot), PACKED).repartition("slot").sortWithinPartitions("slot")
    found = told.mapInArrow(_add_contexts(folder), ", ".join(f"{f} long" for f in FACTS)).collect()  # two rows per part and level
    held = {k: {r["part"] for r in found if r["level"] == k} for k in [*range(1, order + 1), *range(-order, -2)]}
    total = lambda level, field: sum(r[field] for r in found if r["level"] == level)
    ones = {k: [total(k, f"n{i}") for i in range(1, 5)] for k in range(1, order + 1)}
    taken_from = {k: discounts(n) for k, n in ones.items()}
    n_pairs, known, lower = total(2, "rows"), total(1, "words"), taken_from[1]
    taken = lower[1] * ones[1][0] + lower[2] * ones[1][1] + lower[3] * (known - ones[1][0] - ones[1][1])
    return Model(folder, order, parts, held, total(1, "tokens"), known, n_pairs, taken_from, taken / n_pairs if n_pairs else 1.0, numbering)


# --- scoring ---------------------------------------------------------------------------------------


class Lookup:
    """A worker's view of a model's arrays."""

    def __init__(self, model: Model) -> None:
        self.model, self.maps, self.tables = model, {}, {}

    def _mapped(self, kind: type, name: str, *more):
        if name not in self.maps:
            path = f"{self.model.folder}/{name}"
            self.maps[name] = kind(_read_arrays(path) if kind is Counted else path, *more)
        return self.maps[name]

    def _following(self, level: int) -> Callable:
        """Of fields as a context: how much follows, and the part of it that is kept back for the level below (all, if nothing follows)."""
        taken = self.model.discounts[level + 1][1:]
        return lambda f: np.column_stack((f[:, 0], np.where(f[:, 0] > 0, f[:, 1:] @ taken / np.maximum(f[:, 0], 1), 1.0)))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per place of a word, places 0 to 2 being the marks': its number; and its chance at the lowest level, the base's logarithm, whether it is known,
        and what follows it."""
        m, numbers, facts = self.model, [], []
        for at in range(0, len(hashes), REMEMBERED):
            number = m.numbering.numbers(hashes[at : at + REMEMBERED], self.tables)
            number[: 1 - min(at, 1)] = NONE
            fields = np.zeros((len(number), WORD_FIELDS), np.int64)
            known = np.flatnonzero((number != NONE) & (number != UNKNOWN))
            part = (number[known] - np.uint64(1)) % np.uint64(m.parts)
            order = np.argsort(part, kind="stable")
            known, part = known[order], part[order].astype(np.int64)
            for a, b in _ranges(part):
                table = self._mapped(Table, f"grams1-{part[a]}")
                place, hit = table.place(number[known[a:b]])
                fields[known[a:b][hit]] = table.counted.at(place[hit])
            times, types = fields[:, 0], fields[:, 1]
            base = np.log10((times + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
            lowest = np.maximum(types - m.discounts[1][np.minimum(types, 3)], 0) / max(m.pairs, 1) + m.unseen()
            numbers.append(number)
            facts.append(np.column_stack((lowest, base, times > 0, self._following(1)(fields[:, 2:]))))
        return np.concatenate(numbers), np.concatenate(facts)

    def find(self, number: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the grams that end ``here`` among the words' numbers, by level from pairs on: their counts, and what follows them as contexts."""
        m = self.model
        counts, followed = np.zeros((m.order - 1, len(here)), np.int64), np.zeros((m.order - 2, len(here), 2))
        followed[:, :, 1] = 1
        row = np.flatnonzero((number[here] != UNKNOWN) & (number[here - 1] != UNKNOWN))
        part = gram_part(number[here[row] - 1], number[here[row]], m.parts, m.numbering.hot)
        order = np.argsort(part.astype(np.uint16) if m.parts < 1 << 16 else part, kind="stable")
        row, part = row[order], part[order]
        at = here[row]
        columns = [number[at - 1], number[at], *[number[at - i] for i in range(2, m.order)]]
        for a, b in _ranges(part):
            name = int(part[a])
            if name not in m.held[m.order]:
                continue
            grams = self._mapped(Trie, f"grams-{name}")
            for level, found, place in grams.find([c[a:b] for c in columns]):
                found = row[a:b][found]
                counts[level - 2, found] = grams.counts(level, place)
                if level < m.order and name in m.held[-1 - level]:
                    followed[level - 2, found] = self._mapped(Counted, f"followed{level}-{name}", self._following(level)).at(place)
        return counts, followed

    def log_scores(self, places: np.ndarray, number: np.ndarray, facts: np.ndarray, tokens: np.ndarray, more: int) -> np.ndarray:
        """Of tokens at some of the ``places`` (but the first ``more``): log10 of the model's and of the base's probability, and whether the word is known.

        Tokens follow each other, so that what follows a token's context is what follows the token before it with its own history. Where tokens go on
        from others, the one before them comes first and makes ``more`` one.
        """
        m = self.model
        counts, followed = self.find(number, tokens)
        ahead = np.zeros((m.order - 2, 1 - more, 2))
        followed = np.concatenate((ahead, followed[:, :-1]), axis=1)
        counts, tokens = counts[:, more:], tokens[more:]
        followed[:, places[tokens - 1] == 1] = 0, 1  # a text opens
        found, base, known = facts[places[tokens], :3].T
        total, kept_back = facts[places[tokens - 1], 3:].T
        for level in range(2, m.order + 1):
            count = counts[level - 2]
            direct = np.maximum(count - m.discounts[level][np.minimum(count, 3)], 0) / np.maximum(total, 1)
            found = np.where(total > 0, direct, 0) + kept_back * found
            if level < m.order:
                total, kept_back = followed[level - 2].T
        return np.stack((np.log10(found), base, known))


SCORES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` per row, in one pass without shuffle.

    A null or empty text is its end mark. An untrained model gives every token its even share of an empty vocabulary, log 0. Null ids and
    repeated rows come back as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(model)

        def scored(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            places, hashes, n_tokens = word_places(texts, model.order)
            number, facts = lookup.words(hashes)
            number = number[places]
            tokens, owner = np.flatnonzero(places > 1), np.repeat(np.arange(len(texts)), n_tokens)
            sums = np.zeros((3, len(texts)))
            for at in range(0, len(tokens), LOOKUP):
                more = min(at, 1)
                values, own = lookup.log_scores(places, number, facts, tokens[at - more : at + LOOKUP], more), owner[at : at + LOOKUP]
                first = _firsts(own)
                sums[:, own[first]] += np.add.reduceat(values, first, axis=1)
            values = [n_tokens, sums[2].astype(np.int64), np.full(len(texts), model.tokens, np.int64), sums[1], sums[0]]
            return pa.record_batch([ids, *map(pa.array, values)], names=["doc_id", *SCORES])

        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                yield scored(batch.column(0).slice(at, len(texts)), texts)
                at += len(texts)

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def perplexity(log10_score: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -log10_score / n_tokens)


def score_folds(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores all documents with a model of those outside fold 0 of 10."""
    held_out = fold("doc_id", 10) == 0
    scored = score(docs, train(docs.filter(~held_out), order=order))
    return scored.select("doc_id", held_out.alias("held_out"), *SCORES, perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))
