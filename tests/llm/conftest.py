import pytest

LONG = " ".join(f"word{i % 977} über, and {i % 13}." for i in range(12_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", 44),
    (2, "the QUICK brown fox jumps over the lazy dog.", None, "a", 44),
    (2, "the QUICK brown fox jumps over the lazy dog.", None, "a", 44),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, " \t\n", "de", "b", 3),
    (None, "Der schnelle Fuchs und die Katze, ring +1 (366) 555-9807 🙂", "de", "b", 60),
    (6, LONG, "en", "c", len(LONG)),
    (7, "one two", "en", "c", 7),
    (8, "1234 5678 !!!", None, "c", 13),
    (3, "Le chat est sur la table de la maison", "fr", "a", 37),
]
CLASHES = ["fp", "component_id", "lang_pred", "score", "copies", "n_tokens", "slot", "shard", "sketch", "range", "rank", "kind", "spans", "_stay", "_rows", "key", "cosine", "digest", "_digest", "_id", "root"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and ids, and extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3).persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0).persist()


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def documents(spark, tiny):
    """The smallest documents table, as a list of (doc_id, text, lang, source) by id."""
    df = spark.read.parquet(f"{tiny}/documents.parquet")
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
