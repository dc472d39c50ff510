import functools
import zlib
from collections import Counter, defaultdict

import numpy as np

from pagemill.llm import hyperlang, queries


def test_query(spark, documents):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text").collect()}
    got = queries.QUERIES["op2_language_profiles"](spark, folder).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert np.mean([truth[r.doc_id][0] == r.lang_pred for r in held]) > 0.97


def test_cosine_of_bundles():
    letters = hyperlang.Letters(256)
    vectors, has = hyperlang.encode_texts(letters, ["Ab c!", None, "", "123", "ab  C"])
    assert has.tolist() == [True, False, False, False, True]
    assert np.allclose(vectors[0], vectors[4]) and np.allclose(np.linalg.norm(vectors[0]), 1) and not vectors[1:4].any()
    v = {c: hyperlang._letter_vector(ord(c), 256).astype(float) for c in " abc"}
    want = sum(np.roll(v[x], 2) * np.roll(v[y], 1) * v[z] for x, y, z in (" ab", "ab ", "b c", " c "))
    assert np.allclose(vectors[0], want / np.linalg.norm(want))


def test_pieces_equal_whole(monkeypatch, rows):
    letters, text = hyperlang.Letters(256), rows[7][1][:5000]
    whole, _ = hyperlang.encode_texts(letters, [text])
    monkeypatch.setattr(hyperlang, "SLAB", 50)
    slabs, _ = hyperlang.encode_texts(letters, [text])
    assert np.allclose(whole, slabs, atol=1e-5)


def test_odd_rows(odd, none, rows):
    got = hyperlang.identify(odd).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (4, 5, 8)} == {(4, "und"), (5, "und"), (8, "und")}
    assert hyperlang.identify(none).collect() == []
    unlabelled = odd.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in hyperlang.identify(unlabelled).collect()} == {"und"}


def spelled(text):
    """Trigrams of a text by plain string work."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    line = f" {' '.join(runs.split())} "
    return Counter(line[i : i + 3] for i in range(len(line) - 2))


@functools.cache
def bound(gram, size):
    x, y, z = (hyperlang._letter_vector(ord(c), size).astype(float) for c in gram)
    return np.roll(x, 2) * np.roll(y, 1) * z


def vector(text, size=hyperlang.DIMENSIONS):
    total = np.zeros(size)
    for gram, n in spelled(text).items():
        total += n * bound(gram, size)
    return total / max(np.linalg.norm(total), 1e-12)


def test_query_against_brute_force(spark, tiny, documents):
    """Predictions and scores of the whole table, with prototypes bundled in plain Python."""
    vectors, sums = {d: vector(t) for d, t, *_ in documents}, defaultdict(float)
    for d, _, lang, _ in documents:
        if lang is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            sums[lang] = sums[lang] + vectors[d]
    labels = sorted(sums)
    prototypes = np.array([sums[x] / np.linalg.norm(sums[x]) for x in labels])
    middle = prototypes.mean(axis=0)
    seen = (prototypes - middle) / np.linalg.norm(prototypes - middle, axis=1, keepdims=True)
    got = {r.doc_id: r for r in queries.QUERIES["op2_language_profiles"](spark, tiny).collect()}
    for d, text, *_ in documents:
        if not any(c.isalpha() for c in text or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
            continue
        cosine = seen @ (vectors[d] - middle) / np.linalg.norm(vectors[d] - middle)
        share = np.exp(hyperlang.SHARPNESS * cosine)
        assert got[d].lang_pred == labels[int(cosine.argmax())] or np.ptp(np.sort(cosine)[-2:]) < 1e-4
        assert abs(got[d].score - share.max() / share.sum()) < 1e-3


def test_relabel(spark):
    """Over 10,000 documents: no clean one goes, contradicting labels and missing ones are set right, texts of no learned language go."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    wrong = F.crc32(F.concat(F.lit("w"), F.col("doc_id").cast("string")).cast("binary")) % 50
    order = F.expr("element_at(map('en', 'de', 'de', 'es', 'es', 'fr', 'fr', 'en'), lang)")
    marked = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(wrong == 0, order).when(wrong == 1, F.lit(None)).otherwise(F.col("lang")))
    r = np.random.default_rng(3)
    noise = ["".join(chr(97 + x) for x in r.integers(0, 26, 400)) for _ in range(50)]
    noise += ["".join("0123456789abcdef"[x] for x in r.integers(0, 16, 400)) for _ in range(50)]
    noise += ["Każdy człowiek ma prawo do wolności myśli, sumienia i wyznania, prawo to obejmuje swobodę zmiany wyznania lub wiary", "Η γλώσσα των προγραμμάτων είναι μια μεγάλη ιστορία που δεν τελειώνει ποτέ και αλλάζει κάθε χρόνο"]
    real = [
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience.",
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt.",
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos, dotados como están de razón y conciencia.",
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience.",
    ]
    extra = [(-1 - i, t, None, "noise") for i, t in enumerate(noise)] + [(-1000 - i, t, None, x) for i, (t, x) in enumerate(zip(real, ("en", "de", "es", "fr")))]
    both = marked.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, truth string"))
    kept = hyperlang.relabel(both).select("doc_id", "lang", "truth").collect()
    lettered = docs.filter(F.col("text").rlike(r"\p{L}")).count()
    clean = [x for x in kept if x.doc_id >= 0]
    right = np.mean([x.lang == x.truth for x in clean])
    left = [-1 - x.doc_id for x in kept if x.truth == "noise"]
    print("clean kept", len(clean), "of", lettered, "right", right, "noise kept", left, "real", [(x.lang, x.truth) for x in kept if x.doc_id <= -1000])
    assert len(clean) == lettered and right > 0.998
    assert not [i for i in left if i >= 100] and sum(i < 50 for i in left) <= 2 and len(left) <= 20  # hexadecimal digits have few letters to judge by
    assert [x.lang == x.truth for x in kept if x.doc_id <= -1000] == [True] * 4
