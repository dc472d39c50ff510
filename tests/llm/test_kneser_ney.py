import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import kneser_ney, queries


def tokens(text):
    return (text or "").encode().lower().split() + ["end"]


class Brute:
    """Dictionaries of all grams: counts at the full order and where a text begins, different words before a gram below that."""

    def __init__(self, texts, order=kneser_ney.ORDER):
        self.order, self.words = order, Counter()
        counts = {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            w = ["begin", *w]
            counts[order].update(zip(*[w[i:] for i in range(order)]))
            for k in range(2, order):
                counts[k].update([tuple(w[:k])] if len(w) >= k else [])
        for k in range(order, 1, -1):
            for gram in counts[k]:
                counts[k - 1][gram[1:]] += 1
        self.counts, self.context, self.followers = counts, Counter(), defaultdict(lambda: [0, 0, 0])
        for k in range(2, order + 1):
            for gram, c in counts[k].items():
                self.context[gram[:-1]] += c
                self.followers[gram[:-1]][min(c, 3) - 1] += 1
        self.n, self.v, self.pairs = sum(self.words.values()), len(self.words), len(counts[2])
        seen = lambda values: [sum(c == i for c in values.values()) for i in (1, 2, 3, 4)]
        self.d = {k: kneser_ney.discounts(seen(c)) for k, c in counts.items()}
        self.left = sum(self.d[1][min(c, 3)] for c in counts[1].values()) / self.pairs if self.pairs else 1.0

    def p(self, before, w):
        if not before:
            c = self.counts[1][w,]
            return max(c - self.d[1][min(c, 3)], 0) / max(self.pairs, 1) + self.left / (self.v + 1)
        lower = self.p(before[1:], w)
        if not self.context[before]:
            return lower
        c, d = self.counts[len(before) + 1][*before, w], self.d[len(before) + 1]
        kept = sum(d[i + 1] * self.followers[before][i] for i in range(3)) / self.context[before]
        return max(c - d[min(c, 3)], 0) / self.context[before] + kept * lower

    def row(self, text):
        w = tokens(text)
        base = sum(math.log10((self.words[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        whole, score = ["begin", *w], 0.0
        for i in range(1, len(whole)):
            score += math.log10(self.p(tuple(whole[max(0, i - self.order + 1) : i]), whole[i]))
        return len(w), sum(self.words[x] > 0 for x in w), self.n, base, score


def same(got, want):
    assert tuple(got[:3]) == want[:3] and got[3] == pytest.approx(want[3], abs=1e-7) and got[4] == pytest.approx(want[4], abs=1e-7)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_add_up(documents, order):
    model = Brute([t for _, t, *_ in documents], order)
    first = tokens(documents[0][1])
    for before in (("begin",), (b"the",), (b"of", b"the"), ("begin", first[0]), tuple(first[:3]), (b"never seen",)):
        before = before[: order - 1]
        assert sum(model.p(before, w) for w in model.words) + model.p(before, b"never seen") == pytest.approx(1)


def test_query(spark, tiny, documents):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    model = Brute([t for d, t, *_ in documents if not held(d)])
    got = {r.doc_id: r for r in queries.QUERIES["op5_kneser_ney"](spark, tiny).collect()}
    assert sorted(got) == [d for d, *_ in documents]
    for d, t, *_ in documents:
        assert got[d].held_out == held(d)
        same(tuple(got[d][c] for c in kneser_ney.SCORES), model.row(t))
    test = [got[d] for d, *_ in documents if held(d)]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_orders_and_small_buffers(spark, documents, monkeypatch, order):
    for name, value in (("FLUSH", 500), ("LOOKUP", 300), ("REMEMBERED", 40), ("PART_BYTES", 2000)):
        monkeypatch.setattr(kneser_ney, name, value)
    some = [*documents[:60], (60, "one", "en", "s"), (61, "one two", "en", "s"), (62, "", "en", "s")]
    df = spark.createDataFrame([(n, d[1]) for n, d in enumerate(some)], "doc_id long, text string").repartition(3)
    brute, model = Brute([d[1] for d in some], order), kneser_ney.train(df, order=order)
    assert model.parts > 30
    for r in kneser_ney.score(df, model).collect():
        same(tuple(r)[1:], brute.row(some[r.doc_id][1]))


def test_odd_rows(odd, none, rows):
    model = Brute([r[1] for r in rows])
    got = kneser_ney.score(odd, kneser_ney.train(odd)).collect()
    assert len(got) == len(rows)
    want = {(r[0], len(tokens(r[1]))): model.row(r[1]) for r in rows}
    for r in got:
        same(tuple(r)[1:], want[r.doc_id, r.n_tokens])
    assert kneser_ney.score_folds(none).collect() == []
    untrained = kneser_ney.score(odd, kneser_ney.train(none)).collect()
    assert len(untrained) == len(rows) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in untrained)


def test_counts_beyond_four_bytes(tmp_path):
    """A context seen three thousand million times before each of two words keeps its count on the way to the word files."""
    grams = np.array([[77, 5], [77, 9]], np.uint64)
    rows = kneser_ney._packed(np.zeros(2, np.int64), 2, grams, np.array([[3_000_000_000]] * 2))
    told = list(kneser_ney._add_grams(2, str(tmp_path), 1)(kneser_ney._rows(rows)))
    told = pa.Table.from_batches(told).sort_by("slot").to_batches()
    found = [r for b in kneser_ney._add_contexts(str(tmp_path))(iter(told)) for r in b.to_pylist()]
    assert [r["tokens"] for r in found if r["level"] == 1] == [6_000_000_000]
    words = kneser_ney.Table(f"{tmp_path}/grams1-0")
    facts = dict(zip(words.keys().tolist(), words.values.tolist()))
    assert facts[77][2] == 6_000_000_000 and facts[5][0] == facts[9][0] == 3_000_000_000 and facts[77][5] == 2


def test_tables(tmp_path):
    """Every key is found at its place, no other key is; keys that share their first bits, and tables of none."""
    draw = np.random.default_rng(3)
    for n in (0, 1, 5000):
        keys = np.unique(np.concatenate((draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), draw.integers(0, 1 << 20, n, dtype=np.uint64))))
        counts = draw.integers(0, 300, (len(keys), 3))
        kneser_ney.Table.write(f"{tmp_path}/t{n}", keys, counts)
        table = kneser_ney.Table(f"{tmp_path}/t{n}")
        place, found = table.place(keys)
        assert (place == np.arange(len(keys))).all() and found.all() and (table.values == counts).all() and (table.keys() == keys).all()
        other = np.setdiff1d(draw.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
        assert not table.place(other)[1].any()


def test_packed_words():
    draw = np.random.default_rng(4)
    for n, most in ((1, 5), (4000, 9), (4000, 1 << 47), (70_000, 1 << 47)):
        words, counts = draw.integers(0, most, (n, 3), dtype=np.uint64), draw.integers(0, 1 << 40, (n, 2))
        back, numbers = kneser_ney._unpacked(kneser_ney._joined([kneser_ney._squeezed(counts), *kneser_ney._packed_words(words)]), 3, 2)
        assert (back == words).all() and (numbers == counts).all()


def test_packets_hold_no_dictionary():
    """Grams of Zipf's words travel in less than five bytes each, though nearly every gram brings a word that its packet has not seen."""
    draw = np.random.default_rng(5)
    words = np.exp(draw.random((60_000, 3)) * math.log(400_000)).astype(np.uint64)
    words[:, 1] //= np.uint64(40)  # a part has few of the words in the middle
    words = np.unique(words, axis=0)
    ((_, _, data),) = kneser_ney._packed(np.zeros(len(words), np.int64), 3, words, np.ones((len(words), 1)))
    assert len(data) < 5 * len(words)
    back, counts = kneser_ney._unpacked(data, 3, 1)
    assert len(back) == len(words) and (np.unique(back, axis=0) == words).all() and (counts == 1).all()


def test_word_places():
    """Words are what lies between ASCII white space, whatever else is in the text; a null text is its marks."""
    texts = [*(f"A{chr(i)}b" for i in range(256)), "  x ", "", None, "\n\n", "ÀB  c d e", " a b"]
    for order in (2, 3):
        places, hashes, n = kneser_ney.word_places(pa.array(texts, pa.string()), order)
        words = [(t or "").encode().lower().split() for t in texts]
        assert n.tolist() == [len(w) + 1 for w in words]
        want = [h for w in words for h in [*[kneser_ney.BEGIN] * (order - 1), *kneser_ney._hashes(w).tolist(), kneser_ney.END]]
        assert hashes[places].tolist() == want and (places == 0).sum() == (order - 2) * len(texts)


def test_counted():
    draw = np.random.default_rng(6)
    few = np.minimum(draw.zipf(1.7, (20_000, 2)), 5000)
    for counts in (few, few[:1], few[:0], draw.integers(0, 1 << 40, (3000, 4)), draw.integers(0, 30, (5000, 2)), few * 10_000_000_000):
        kept = kneser_ney.Counted(kneser_ney.Counted.arrays(counts))
        assert (kept.at(np.arange(len(counts))) == counts).all()
        doubled = kneser_ney.Counted(kneser_ney.Counted.arrays(counts), lambda x: 2 * x)
        assert (doubled.at(np.arange(len(counts))) == 2 * counts).all()


@pytest.mark.parametrize("most", [3, 200, 70_000, 1 << 34])
def test_trie(tmp_path, most):
    """Grams and their endings are found with their counts, others are not; numbers of all widths."""
    draw = np.random.default_rng(most)
    grams = {tuple(g): i + 1 for i, g in enumerate(draw.integers(1, most, (2000, 4)).tolist())}
    words = np.array(sorted(grams), np.uint64)
    packed = kneser_ney._packed(np.zeros(len(words), np.int64), 4, words, np.array([[grams[tuple(g)]] for g in words.tolist()]))
    list(kneser_ney._add_grams(4, str(tmp_path), 1)(kneser_ney._rows(packed)))
    trie = kneser_ney.Trie(f"{tmp_path}/grams-0")
    other = draw.integers(1, most + 5, (2000, 4)).astype(np.uint64)
    asked = np.concatenate((words, other))
    endings = {k: Counter(g[1:] for g in {h[3 - k :] for h in grams}) for k in (2, 3)}
    got = {}
    for level, row, place in trie.find([asked[:, 2], asked[:, 3], asked[:, 1], asked[:, 0]]):
        got[level] = dict(zip(row.tolist(), trie.counts(level, place).tolist()))
    for i, g in enumerate(asked.tolist()):
        for level in (2, 3, 4):
            assert got[level].get(i, 0) == (grams if level == 4 else endings[level]).get(tuple(g)[4 - level :], 0)
