"""Overlaps of two tokenizers against a plain walk over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import public_tokenizers
from pagemill.llm import token_links

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known():
    return token_links.vocabularies(*PATHS)


def ranges(pieces):
    out, at = [], 0
    for piece in pieces:
        out.append((at, at + len(piece)))
        at += len(piece)
    return out


def by_hand(texts, known):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), from all pairs of byte ranges."""
    found, counts = [], Counter()
    for text in texts:
        a = known.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = known.b.encode(text) if text else []
        whole = f" {text}".encode()
        if b"".join(known.a_bytes[x] for x in a) != whole or b"".join(known.b_bytes[x] for x in b) != whole:
            a, b = [], []
        left, right = ranges([known.a_bytes[x] for x in a]), ranges([known.b_bytes[x] for x in b])
        by_byte = defaultdict(list)
        for n, (start, stop) in enumerate(right):
            for at in range(start, stop):
                by_byte[at].append(n)
        links = sorted({(m, n) for m, (start, stop) in enumerate(left) for at in range(start, stop) for n in by_byte[at]})
        ends = sorted({stop for _, stop in left} & {stop for _, stop in right})
        groups, last = [], 0
        for end in ends:
            inside = lambda spans, ids: ",".join(str(x) for x, (s, e) in zip(ids, spans) if last <= s and e <= end)  # noqa: B023, E731
            groups.append(inside(left, a) + "|" + inside(right, b))
            last = end
        pairs = [(a[m], b[n]) for m, n in links]
        counts.update(pairs)
        found.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(a, b, g, len(p), sum(counts[x] == highest[x[1]] for x in p), sum(counts[x] for x in p), sha) for a, b, g, p, sha in found]


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


ODD = [
    "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", " ", "  \n\t x  ", "naïve 漢字 🙂🙂 ñ", "x" * 400, "\x00\x01", "don't WON'T 12345 3.14", "​ ", "   ", "é" * 50,
]


@pytest.mark.parametrize("chunk", [token_links.CHUNK, 200])
def test_odd_rows(spark, odd, rows, known, chunk):
    texts = [(r[0], r[1][:4000] if r[1] else r[1]) for r in rows] + [(100 + n, t) for n, t in enumerate(ODD)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n_a", "'x' AS key", "2 AS chunk", "3 AS pairs").repartition(3)
    want = sorted(((i, *x) for (i, _), x in zip(texts, by_hand([t for _, t in texts], known))), key=repr)
    assert rows_of(token_links.measure(df, *PATHS, chunk=chunk)) == want
    assert rows_of(token_links.measure(odd, *PATHS))  # a long text and clashing columns


def test_given_documents(spark, tiny, documents, known):
    some = [d for d in documents if not d[1] or len(d[1]) < 3000]
    df = spark.createDataFrame([d[:2] for d in some], "doc_id long, text string").repartition(3)
    assert rows_of(token_links.measure(df, *PATHS, a_pattern=public_tokenizers.PATTERN, chunk=20_000)) == sorted(((d[0], *x) for d, x in zip(some, by_hand([d[1] for d in some], known))), key=repr)


def test_lanes_make_no_difference():
    draw = random.Random(2)
    for _ in range(200):
        a_ends, b_ends, bounds, at = [], [], [0], 0
        for _ in range(draw.randrange(1, 6)):
            size = draw.choice([0, 1, 3, 40])
            for ends in (a_ends, b_ends):
                ends += sorted(draw.sample(range(at + 1, at + size), draw.randrange(size))) + [at + size] if size else []
            at += size
            bounds.append(len(a_ends))
        a, b, bounds = np.array(a_ends, np.int64), np.array(b_ends, np.int64), np.array(bounds)
        links, cuts = token_links.walk(a, b, bounds)
        starts = lambda ends: np.concatenate([[0], ends[:-1]])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts(a)[i] < b[j] and starts(b)[j] < a[i]] if len(a) else []
        assert list(zip(*map(list, links))) == want and list(zip(*map(list, cuts))) == [(i, j) for i, j in want if a[i] == b[j]]
        for lane in (1, 2, 7):
            again = token_links.walk(a, b, bounds, lane)
            assert all((x == y).all() for one, two in zip((links, cuts), again) for x, y in zip(one, two))


def test_alignments(spark, known):
    df = spark.createDataFrame([(1, "hello wonderful wörld"), (2, None), (3, "ab")], "id long, body string").repartition(1)
    got = {r.id: r for r in token_links.alignments(df, *PATHS, key="id", text="body").collect()}
    assert got[2].a_ids == got[2].links == got[2].cuts == []
    for i, text in ((1, "hello wonderful wörld"), (3, "ab")):
        a, b = ranges([known.a_bytes[x] for x in got[i].a_ids]), ranges([known.b_bytes[x] for x in got[i].b_ids])
        assert [tuple(x) for x in got[i].links] == [(m, n) for m in range(len(a)) for n in range(len(b)) if a[m][0] < b[n][1] and b[n][0] < a[m][1]]
        assert [tuple(x) for x in got[i].cuts] == [(m, n) for m, n in map(tuple, got[i].links) if a[m][1] == b[n][1]]
        assert a[-1][1] == len(f" {text}".encode())


def test_both_encoders_of_a_agree(known, documents):
    quick = token_links.vocabularies(*PATHS, public_tokenizers.PATTERN)
    draw = random.Random(1)
    marks = ["'s", "'ll", " \n", "<|endoftext|>", "\r\n", *"   abcABC019.,'\t"]
    texts = ["".join(draw.choice([chr(draw.randrange(1, 0x250)), chr(draw.randrange(0x1F000, 0x1F700)), draw.choice(marks)]) for _ in range(30)) for _ in range(2000)]
    for text in [" " * 1_000_000, "^" * 100_000, *ODD, *texts, *[d[1] or "" for d in documents]]:
        assert quick._a_ids(" " + text) == known._a_ids(" " + text)


def test_none(spark, none):
    assert token_links.measure(none, *PATHS).collect() == [] and token_links.alignments(none, *PATHS).collect() == []
