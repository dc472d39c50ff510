"""Personal data: rule spans plus spans of a character tagger.

The rules find e-mail addresses, network addresses, payment cards and phone numbers in whole texts. The tagger learns from
rule spans and from written-out variants of them, and adds spans the rules miss. Every kind holds a digit or an ``@``, so it reads only the
surroundings of those characters: in windows that overlap by half. A position's tag probabilities are averaged over its windows, one best
path is taken over each connected stretch of text, and a span is added if it is likely enough, well-formed, and apart from rule spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagemill.llm.tagger import Tagger, best_path, encode

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, AROUND = 64, 32, 36
SURE = 0.9  # mean probability a tagger's span must reach
SAMPLE_DOCS = 2_000  # training documents at most, those of smallest hash of the id
SAMPLE_WINDOWS = 3_000  # training windows at most
STEPS = 350

# The contract's patterns. A lookbehind spares starts inside a run of digits, where no match can begin.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def _digits(text: str) -> str:
    return NOT_DIGIT.sub("", text)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _ip_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the rules, ordered by start and then kind; code points, end exclusive."""
    if not ANCHOR.search(text):
        return []
    found = [(a, b, 0) for a, b in _emails(text)]
    found += [(m.start(), m.end(), 1) for m in IP.finditer(text) if _ip_parts(m[0])]
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def stretches(text: str) -> list[tuple[int, int]]:
    """The surroundings of digits and ``@``, merged where they meet."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        low, high = max(0, m.start() - AROUND), min(len(text), m.start() + AROUND + 1)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _windows(low: int, high: int) -> list[int]:
    return list(range(low, max(low + 1, high - WINDOW + STRIDE), STRIDE))


def _tags(spans: list[tuple[int, int, int]], start: int, width: int) -> np.ndarray:
    out = np.zeros(width, np.int8)
    for a, b, kind in spans:
        low, high = max(a, start), min(b, start + width)
        if low < high:
            out[low - start : high - start] = 2 + 2 * kind
            if a >= start:
                out[a - start] = 1 + 2 * kind
    return out


# --- training --------------------------------------------------------------------------------------


def _made(r: np.random.Generator) -> tuple[str, int | None]:
    """A written-out value and its kind, or a harmless one with digits and None."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    name = lambda n: "".join(chr(97 + i) for i in r.integers(0, 26, n))
    pick = lambda *options: options[r.integers(0, len(options))]
    kind = r.integers(0, 8)
    if kind == 0:
        local = name(r.integers(2, 9)) + pick("", ".", "_", "-") + pick(name(r.integers(2, 8)), d(2))
        return local + pick("@", "@", " @ ") + name(r.integers(3, 9)) + pick("", d(1)) + "." + pick("com", "org", "net", "de", "example.com"), 0
    if kind == 1:
        return ".".join(str(x) for x in r.integers(0, 256, 4)), 1
    if kind == 2:
        number = d(15)
        number += next(c for c in "0123456789" if luhn(number + c))
        gap = pick("", "", " ", "-")
        return gap.join(number[i : i + 4] for i in range(0, 16, 4)), 2
    if kind in (3, 4):
        a, b, c = d(3), d(3), d(4)
        return pick(f"+{d(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(2)} {a} {b} {c}", f"{a} {b} {c}"), 3
    return pick(
        f"{r.integers(1900, 2100)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}", f"{d(2)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(1)},{d(3)}.{d(2)}",
        d(r.integers(1, 9)), "".join("0123456789abcdef"[i] for i in r.integers(0, 16, 32)), f"{d(2)}-{d(2)}", f"Version {d(1)}.{d(1)}", f"No. {d(5)}",
        f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"password={d(6)}{name(3)}{d(4)}", f"@{name(6)}", f"{name(3)}@", f"{d(4)}{name(2)}{d(3)}", f"${d(3)}.{d(2)}", f"{d(3)}/{d(3)}",
        f"AKIA{name(4).upper()}{d(3)}{name(6).upper()}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(10)}", f"{d(6)}-{d(4)}-{d(6)}",
    ), None


def _training_windows(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Windows of the sample with their rule tags."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.join(F.broadcast(ids.withColumnRenamed("doc_id", "_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tags = [], []
            for value in batch.column(0):
                text = value.as_py() or ""
                spans = rule_spans(text)
                for low, high in stretches(text):
                    for at in _windows(low, high):
                        texts.append(text[at : at + WINDOW])
                        tags.append(_tags(spans, at, WINDOW).tobytes())
            yield pa.record_batch([pa.array(texts, pa.string()), pa.array(tags, pa.binary())], names=["text", "tags"])

    found = rows.select("text").mapInArrow(cut, "text string, tags binary")
    ordered = found.distinct().orderBy(F.xxhash64("text"), "text", "tags").limit(SAMPLE_WINDOWS)
    return [(r["text"], bytes(r["tags"])) for r in ordered.collect()]


def train(docs: DataFrame, seed: int = 11) -> Tagger | None:
    """A tagger from a bounded sample of the documents and as many made-up values set into their text."""
    if not docs.head(1):
        return None  # nothing to tag
    real = _training_windows(docs)
    r = np.random.default_rng(seed)
    plain = [t for t, tags in real if not any(tags)] or ["the quick brown fox jumps over the lazy dog and runs off again "]
    codes = [encode(t, WINDOW) for t, _ in real]
    tags = [np.frombuffer(g, np.int8) for _, g in real]
    for _ in range(SAMPLE_WINDOWS):
        around = re.sub(r"[0-9@]", "", plain[r.integers(0, len(plain))])
        at = int(r.integers(0, min(len(around), WINDOW - 8) + 1))
        value, kind = _made(r)
        text = around[:at].rstrip() + " " + value + ["", ".", ","][r.integers(0, 3)] + " " + around[at:].lstrip()
        begin = len(around[:at].rstrip()) + 1
        shift = int(r.integers(0, 20)) if r.random() < 0.3 else 0
        spans = [] if kind is None else [(begin, begin + len(value), kind)]
        codes.append(encode(text[shift:], WINDOW))
        tags.append(_tags(spans, shift, WINDOW))
    return Tagger.fresh(len(KINDS), seed).fit(np.stack(codes), np.stack(tags).astype(np.int64), STEPS, seed=seed)


# --- tagging ---------------------------------------------------------------------------------------


def _well_formed(value: str, kind: int) -> bool:
    digits = _digits(value)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", value))
    if kind == 1:
        return bool(IP.fullmatch(value)) and _ip_parts(value)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", value)
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?\(?[0-9][0-9() .-]*[0-9]", value)) and bool(re.search(r"[() .-]", value))


def tagger_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Well-formed, likely spans per text, before they are held against the rule spans."""
    parts = [(t, low, high) for t, text in enumerate(texts) for low, high in stretches(text)]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    size, room = 0, 1 << 16
    group: list[tuple[int, int, int]] = []
    for part in parts:
        group.append(part)
        size += part[2] - part[1]
        if size >= room:
            _tag_group(tagger, texts, group, out)
            group, size = [], 0
    if group:
        _tag_group(tagger, texts, group, out)
    return out


def _tag_group(tagger: Tagger, texts: list[str], group: list[tuple[int, int, int]], out: list[list[tuple[int, int, int]]]) -> None:
    starts = [(n, at) for n, (t, low, high) in enumerate(group) for at in _windows(low, high)]
    sums = [np.zeros((high - low, 1 + 2 * len(KINDS)), np.float32) for _, low, high in group]
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]  # the middle of a window counts most
    shares = [np.zeros((len(s), 1), np.float32) for s in sums]
    for i in range(0, len(starts), 512):
        some = starts[i : i + 512]
        codes = np.stack([encode(texts[group[n][0]][at : min(at + WINDOW, group[n][2])], WINDOW) for n, at in some])
        for (n, at), probability in zip(some, tagger.marginals(codes)):
            low = at - group[n][1]
            held = min(WINDOW, len(sums[n]) - low)
            sums[n][low : low + held] += (probability * weight)[:held]
            shares[n][low : low + held] += weight[:held]
    for (t, low, _), total, share in zip(group, sums, shares):
        average = total / share
        if average[:, 1:].sum(axis=1).max() < 0.5:
            continue
        path, at = best_path(average, len(KINDS)), 0
        while at < len(path):
            if not path[at]:
                at += 1
                continue
            kind, end = (path[at] - 1) // 2, at + 1
            while end < len(path) and path[end] == 2 + 2 * kind:
                end += 1
            sure = average[np.arange(at, end), path[at:end]].mean()
            if sure >= SURE and _well_formed(texts[t][low + at : low + end], int(kind)):
                out[t].append((low + at, low + end, int(kind)))
            at = end


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """(rule spans, all spans) per text; a tagger's span that touches a rule span or an earlier one is left out."""
    rules = [rule_spans(t) for t in texts]
    extra = tagger_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for base, added in zip(rules, extra):
        kept = list(base)
        for a, b, kind in added:
            if all(b <= x or a >= y for x, y, _ in kept):
                kept.append((a, b, kind))
        out.append((base, sorted(kept, key=lambda s: (s[0], s[2]))))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind in spans)


@dataclass
class _Slice:
    """Texts of a few rows at a time, so that a batch of long texts needs bounded memory."""

    rows: int = 64

    def __call__(self, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
        for at in range(0, batch.num_rows, self.rows):
            part = batch.slice(at, self.rows)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Counts and digest of the rule spans and all spans, one row per row of ``docs`` (``doc_id``, ``text``).

    A null text is an empty one and has no spans; null ids and repeated rows come back as they are; an empty table gives
    no rows. Without a tagger one is trained on the documents' own sample.
    """
    tagger = tagger or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _Slice()(batch, 1):
                spans = all_spans(tagger, texts)
                counts = [[sum(k == kind for _, _, k in base) for base, _ in spans] for kind in range(len(KINDS))]
                digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in spans]
                added = [len(every) - len(base) for base, every in spans]
                columns = [part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string())]
                columns += [pa.array([written(every) for _, every in spans], pa.string()), pa.array(added, pa.int64())]
                yield pa.record_batch(columns, names=names)

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, done, at = [], 0, 0
    while at < len(spans):
        a, b, kind = spans[at]
        at += 1
        while at < len(spans) and spans[at][0] < b:
            b = max(b, spans[at][1])
            at += 1
        out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars``, where there, counted anew; null texts stay null."""
    tagger = tagger or train(docs.select("doc_id", "text"))
    columns = docs.columns
    text_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _Slice()(batch, text_at):
                done = [masked(t, every) for t, (_, every) in zip(texts, all_spans(tagger, texts))]
                done = [None if null else t for t, null in zip(done, part.column(text_at).is_null().to_pylist())]
                arrays = list(part.columns)
                arrays[text_at] = pa.array(done, pa.string())
                yield pa.record_batch(arrays, names=columns)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
