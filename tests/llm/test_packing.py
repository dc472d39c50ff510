import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from pagemill.llm import bestfit, cutting_stock, queries
from pagemill.llm.tokens import WordEncoder


@pytest.fixture(scope="module")
def path():
    return queries._vocabulary()


@pytest.fixture(scope="module")
def whole(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def covers(parts, length):
    at = 0
    for start, n in sorted(parts):
        assert start == at and n > 0
        at += n
    assert at == length


def test_encoder_equals_whole_text(path, whole, documents, rows):
    words = WordEncoder(path)
    odd = ["Ünï-cödé’s I'M don't '' ...,, a_b <|endoftext|> x<|ENDOFTEXT|>y", "ΣΑΣ İı ẞ", "tab\x1cfs\x1fus nbsp em end", "été 가힣 日本語 1234", "🙂🙂 word,. (word) 'tis 's", "x" * 5000]
    for text in [*odd, *[t for _, t, *_ in documents], *[r[1] for r in rows if r[1] is not None]]:
        assert np.frombuffer(words.encode(text), words.dtype).tolist() == whole(text), text[:80]


def test_encoder_forgets(path, whole, documents, monkeypatch):
    monkeypatch.setattr("pagemill.llm.tokens.REMEMBERED", 50)
    words = WordEncoder(path)
    for _, text, *_ in documents[:20]:
        assert np.frombuffer(words.encode(text), words.dtype).tolist() == whole(text)
        assert len(words) <= 51 and len(words.old) <= 51


def test_best_fit_is_the_plain_one():
    r = np.random.default_rng(0)
    for width in (1, 7, 64, 100):
        lengths = r.integers(1, width + 1, 200).tolist()
        room, rows = [], []
        for i in sorted(range(200), key=lambda i: -lengths[i]):
            fits = [(left, n) for n, left in enumerate(room) if left >= lengths[i]]
            if not fits:
                room.append(width)
                rows.append([])
                fits = [(width, len(room) - 1)]
            n = min(fits)[1]
            room[n] -= lengths[i]
            rows[n].append(i)
        got = bestfit.best_fit(lengths, width)
        assert sorted(i for row in got for i in row) == list(range(200)) and len(got) == len(rows)
        assert all(sum(lengths[i] for i in row) <= width for row in got)


def check_matrices(got, texts, whole, width, end):
    found = defaultdict(list)
    for r in got:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert not ids[r.n_tokens :].any()
        for doc_id, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert places[a:b].tolist() == list(range(b - a))
            found[doc_id].append((start, ids[a:b].tolist()))
    for doc_id, text in texts.items():
        ids = whole(text) + [end]
        covers([(s, len(p)) for s, p in found[doc_id]], len(ids))
        assert [x for _, p in sorted(found[doc_id]) for x in p] == ids
    assert len({r.sequence_id for r in got}) == len(got)


def test_matrices(spark, tiny, documents, whole):
    got = queries.QUERIES["op6_bestfit_matrices"](spark, tiny).collect()
    check_matrices(got, {d: t for d, t, *_ in documents}, whole, 2048, 49_407)
    assert sum(r.n_tokens for r in got) > 0.95 * 2048 * len(got)


def test_matrices_in_runs(spark, documents, whole, path, monkeypatch):
    monkeypatch.setattr(bestfit, "RUN", 16)
    df = spark.createDataFrame([(d, t) for d, t, *_ in documents], "doc_id long, text string").repartition(2)
    got = bestfit.pack(df, path, width=300, end_id=9).collect()
    check_matrices(got, {d: t for d, t, *_ in documents}, whole, 300, 9)
    assert sum(r.n_tokens for r in got) > 0.9 * 300 * len(got)


def check_pieces(got, texts, whole, width):
    found, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = whole(texts[r.doc_id]) + [1]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        found[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        covers(found[doc_id], len(whole(text)) + 1)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        covers(parts, sum(n for _, n in parts))
        assert sum(n for _, n in parts) <= width
    return sum(r.length for r in got) / width / max(len(sequences), 1)


def test_cutting_stock(spark, tiny, documents, whole):
    got = queries.QUERIES["op8_cutting_stock"](spark, tiny).collect()
    assert check_pieces(got, {d: t for d, t, *_ in documents}, whole, 2048) > 0.97


def test_program_is_near_its_bound():
    r = np.random.default_rng(3)
    sizes = np.unique(r.integers(1, 129, 90))
    demand = r.integers(1, 5000, len(sizes)).astype(float)
    patterns, use = cutting_stock.fractional(sizes, demand, 128)
    assert (patterns @ sizes <= 128).all() and np.allclose(patterns.T @ use, demand)
    prices = np.linalg.inv(patterns.T).sum(axis=0)
    best = cutting_stock._knapsack(sizes, prices, 128)[0][128]
    assert use.sum() <= 1.002 * max(demand @ sizes / 128, prices @ demand / max(best, 1))  # prices within any pattern bound the optimum
    plan = cutting_stock.plan({int(s): int(d) for s, d in zip(sizes, demand)}, 128)
    assert plan.sequences <= 1.02 * use.sum() + 2
    assert cutting_stock.plan({}, 128).sequences == 0


def test_knapsack():
    sizes, prices = np.array([2, 3, 5]), np.array([0.3, 0.5, 0.8])
    value, taken = cutting_stock._knapsack(sizes, prices, 11)
    best = max(a * 0.3 + b * 0.5 + c * 0.8 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= 11)
    assert value[11] == pytest.approx(best)
    pattern = cutting_stock._pattern(sizes, taken, 2, 11)
    assert pattern[2] >= 1 and pattern @ sizes <= 11


def test_odd_rows(odd, none, rows, path, whole):
    repeated = [r for r in rows]
    got = cutting_stock.pack(odd, path).collect()
    assert sum(r.length for r in got) == sum(len(whole(r[1])) + 1 for r in repeated)
    assert sorted((r.start, r.length) for r in got if r.doc_id == 4) == [(0, 1)]
    matrices = bestfit.pack(odd, path).collect()
    assert sum(r.n_tokens for r in matrices) == sum(len(whole(r[1])) + 1 for r in repeated)
    assert cutting_stock.pack(none, path).collect() == [] and bestfit.pack(none, path).collect() == []
