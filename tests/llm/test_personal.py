import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pagemill.llm import personal, queries
from pagemill.llm.tagger import Tagger, allowed, best_path, encode


def brute(text):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and personal.luhn(digits(m[0]))]
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.+-0125 9(é", max_size=60))
def test_rules_are_the_patterns(text):
    assert personal.rule_spans(text) == brute(text)


def test_rules_on_long_runs():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1.1." * 50_000, "+1" * 50_000, "1-" * 100_000):
        personal.rule_spans(text)


def test_luhn():
    assert personal.luhn("4709559030084884") and not personal.luhn("4709559030084885")


@pytest.fixture(scope="module")
def tagger(spark, tiny):
    return personal.train(spark.read.parquet(f"{tiny}/documents.parquet"))


def test_gradients():
    t = Tagger.fresh(2, 0)
    t.weights = {k: v.astype(float) for k, v in t.weights.items()}
    r = np.random.default_rng(1)
    codes, tags = r.integers(32, 127, (3, 6)), np.array([[0, 1, 2, 2, 0, 3], [3, 4, 4, 0, 0, 1], [0, 0, 0, 1, 1, 2]])
    _, g = t.gradients(codes, tags)
    for name, weight in t.weights.items():
        at = {"letters": (codes[0, 0], 3), "steps": (0, 1)}.get(name) or tuple(r.integers(0, s) for s in weight.shape)
        old, values = weight[at], []
        for move in (0.02, -0.02):
            weight[at] = old + move
            values.append(t.gradients(codes, tags)[0])
        weight[at] = old
        assert (values[0] - values[1]) / 0.04 == pytest.approx(g[name][at], abs=2e-3), name


def test_marginals_and_path_by_enumeration():
    from itertools import product

    t = Tagger.fresh(1, 3)
    codes = np.array([[65, 64, 49]])
    emissions = t._emissions(codes.T)[0][:, 0]
    rule = t.weights["steps"] + allowed(1)
    weight = {p: np.exp(t.weights["start"][p[0]] + sum(emissions[i, x] for i, x in enumerate(p)) + sum(rule[a, b] for a, b in zip(p, p[1:]))) for p in product(range(3), repeat=3)}
    total = sum(weight.values())
    want = np.array([[sum(w for p, w in weight.items() if p[i] == x) / total for x in range(3)] for i in range(3)])
    assert np.allclose(t.marginals(codes)[0], want, atol=1e-4)
    score = lambda p: sum(np.log(want[i, x] + 1e-6) for i, x in enumerate(p)) + sum(allowed(1)[a, b] for a, b in zip(p, p[1:]))
    assert tuple(best_path(want, 1)) == max(weight, key=score)


def test_tagger_learns(tagger):
    r = np.random.default_rng(77)
    texts, spans = [], []
    for i in range(400):
        value, kind = personal._made(r)
        texts.append(f"sed thon erble {value} anthe ly hered. Then ion")
        spans.append((15, 15 + len(value), kind))
    got = personal.tagger_spans(tagger, texts)
    hit = [s in g for s, g in zip(spans, got) if s[2] is not None]
    wrong = [g for s, g in zip(spans, got) if s[2] is None and g]
    assert np.mean(hit) > 0.6 and len(wrong) <= 8


def test_query(spark, tiny, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op10_personal_data"](spark, tiny).collect()}
    assert sorted(got) == [d for d, *_ in documents]
    for d, text, *_ in documents:
        base, r = brute(text), got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in base) for kind in range(4)]
        assert r.base_sha256 == hashlib.sha256(personal.written(base).encode()).hexdigest()
        spans = [(int(a), int(b), personal.KINDS.index(k)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (s[0], s[2])) and len(spans) == len(base) + r.n_added
    assert sum(r.n_added for r in got.values()) <= 2  # plain documents are left alone


def test_windows_cover_stretches(tagger):
    text = "x" * 50 + "7" * 500 + "y" * 90 + " a.b@c.example.org " + "z" * 30
    for low, high in personal.stretches(text):
        seen = {i for at in personal._windows(low, high) for i in range(at, min(at + personal.WINDOW, high))}
        assert seen == set(range(low, high))
    assert personal.tagger_spans(tagger, ["", "no figures here", text])[:2] == [[], []]
    assert encode("aé🙂", 5).tolist() == [97, 128, 129, 130, 130]


def test_masking():
    text = "a b@c.de f 10.0.0.1"
    assert personal.masked(text, personal.rule_spans(text)) == "a [EMAIL] f [IP]"
    assert personal.masked("0123456789", [(1, 4, 0), (3, 6, 2), (8, 9, 3)]) == "0[EMAIL]67[PHONE]9"


def test_odd_rows(odd, none, rows, tagger):
    got = personal.find(odd, tagger).collect()
    assert len(got) == len(rows) and {r.n_phone for r in got if r.doc_id is None} == {1}
    done = personal.redact(odd, tagger)
    assert done.columns == odd.columns
    kept = {(r.doc_id, r.text, r.n_chars) for r in done.collect()}
    assert (3, None, None) in kept and (4, "", 0) in kept
    assert any(t and "ring [PHONE] " in t and n == len(t) for _, t, n in kept)
    assert personal.find(none).collect() == [] and personal.redact(none).collect() == []
