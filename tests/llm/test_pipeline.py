from collections import Counter

import pytest

import corpus_pipeline
from pagemill.llm import personal

from test_simhash import fingerprint, groups


@pytest.fixture(scope="module")
def staged(spark, tiny, tmp_path_factory):
    """Stage by stage, each written and read again."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{tiny}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tiny).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(staged):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "personal_data", "source_mix", "packing"]
    for name in names[:-1]:
        assert staged[name].columns == staged["input"].columns == corpus_pipeline.COLUMNS


def test_language_keeps_texts_with_letters(staged):
    want = [r.doc_id for r in staged["input"].collect() if r.text and any(c.isalpha() for c in r.text)]
    assert ids(staged["language_id"]) == sorted(want)


def test_one_of_each_group(staged):
    """The least doc_id of every group linked by fingerprints of four-word shingles within four bits, by brute force."""
    items = [(r.doc_id, fingerprint(r.text)) for r in staged["language_id"].collect()]
    assert ids(staged["near_dedup"]) == sorted({least for _, _, least in groups(items)})


def test_personal_data_is_masked(staged):
    before = {r.doc_id: r for r in staged["near_dedup"].collect()}
    for r in staged["personal_data"].collect():
        found = personal.rule_spans(before[r.doc_id].text)
        assert personal.rule_spans(r.text) == [] and r.n_chars == len(r.text)
        if not found:
            assert abs(len(r.text) - len(before[r.doc_id].text)) < 30
    assert ids(staged["personal_data"]) == sorted(before)


def test_mixture_holds_its_share(staged):
    words = lambda df: sum(len(r.text.encode().split()) + 1 for r in df.collect())
    assert words(staged["source_mix"]) / words(staged["personal_data"]) == pytest.approx(corpus_pipeline.MIX_SHARE, abs=0.08)
    shares = Counter(r.source for r in staged["source_mix"].collect())
    assert set(shares) <= {r.source for r in staged["input"].collect()}


def test_packing_takes_all(staged):
    pieces = staged["packing"].collect()
    assert sorted({r.doc_id for r in pieces}) == ids(staged["source_mix"])
    assert all(r.offset + r.length <= 2048 for r in pieces)


def test_run_equals_stages(spark, tiny, staged):
    got = corpus_pipeline.run(spark, tiny)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, staged["packing"].select(got.columns).collect()))


def test_odd_rows_and_none(spark, tiny, odd, none):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, tiny)
            if name != "packing":
                assert docs.columns == corpus_pipeline.COLUMNS
                docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() == 0) == (start is none)
