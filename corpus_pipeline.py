"""A training corpus from the documents table: identify, deduplicate, mask, mix and pack.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents; further columns of the input are dropped. Every stage
reads all that its predecessor kept, takes nulls in any column and texts of any length, and gives an empty table for an empty one. Of
repeated rows near_dedup keeps one; the others keep them all. Ties are settled by hashes or the smallest doc_id, as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import cutting_stock, hyperlang, mixing, personal, simhash
from pagemill.plans.stored import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIX_SHARE = 0.9  # tokens of the mixture, as a share of what came in
SEED = 7
ORACLE_SQL = None  # hashes, trained models and a tokenizer are beyond SQL; the tests hold the stages against brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by ``hyperlang.relabel``: it fills in a missing ``lang`` and overrules a label that a sure prediction contradicts."""
    return hyperlang.relabel(docs.select(COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group linked by SimHash: four-word shingles, at most four differing bits."""
    return simhash.keep_one(docs.select(COLUMNS), radius=4, shingle=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked by the name of its kind and ``n_chars`` counted anew."""
    return personal.redact(docs.select(COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a mixture of 90 % of the tokens: domains, then languages, then sources weigh the same as far as they reach."""
    docs = docs.select(COLUMNS)
    levels = {"_domain": mixing.domain_of(F.col("source")), "_language": F.col("lang"), "_origin": F.col("source")}
    return mixing.mix(docs, levels, share=MIX_SHARE, seed=SEED).filter("copies > 0").select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence of at most 2048 token ids and its place in it."""
    import public_tokenizers

    return cutting_stock.pack(docs.select(COLUMNS), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
