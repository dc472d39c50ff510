"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.llm import bestfit, cutting_stock, hilbert, hyperlang, kneser_ney, link_trust, mixing, personal, sharding, simhash, sketch, token_links, turn_repair

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


@query
def op1_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(_documents(spark, folder, "doc_id", "text"))
    return groups.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_bestfit_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.pack(_documents(spark, folder, "doc_id", "text"), _vocabulary())


@query
def op8_cutting_stock(spark: SparkSession, folder: str) -> DataFrame:
    return cutting_stock.pack(_documents(spark, folder, "doc_id", "text"), _vocabulary())


@query
def op2_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return hyperlang.identify(_documents(spark, folder, "doc_id", "text", "lang"))


@query
def op3_scaled_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compare_edited(_documents(spark, folder, "doc_id", "text"))


SHARDS = [f"shard-{i:03d}" for i in range(128)]


@query
def op4_permutation_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "doc_id", "text", "source")
    sized = docs.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.assign(sized, ["doc_id"], SHARDS)


@query
def op7_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder, "doc_id", "text", "lang", "source")
    levels = {"domain": mixing.domain_of(F.col("source")), "language": F.col("lang"), "origin": F.col("source")}
    mixed = mixing.mix(docs, levels, share=1.0, weights={("domain0",): 2.0, (None, "en"): 2.0}, max_epochs=4.0, seed=7)
    return mixed.select("doc_id", "domain", "language", "origin", "n_tokens", "copies")


@query
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find(_documents(spark, folder, "doc_id", "text"))


@query
def op9_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return hilbert.search(vectors, F.col("vec_id") % 20 == 0)


@query
def op5_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return kneser_ney.score_folds(_documents(spark, folder, "doc_id", "text"))


URL_RULES = [
    link_trust.Rule("allow", "org", "/"),
    link_trust.Rule("block", "example.org", "/es/"),
    link_trust.Rule("block", "example.org", "/en/1"),
    link_trust.Rule("allow", "com", "/fr/"),
    link_trust.Rule("block", "com", "/de/"),
]


@query
def op12_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return link_trust.judge(pages, URL_RULES)


ORACLES["op12_link_trust"] = link_trust.judge_sql(URL_RULES)


@query
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.damaged_and_repaired(spark.read.parquet(f"{folder}/conversations.parquet"))


@query
def op13_token_links(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_links.measure(_documents(spark, folder, "doc_id", "text"), *paths, a_pattern=public_tokenizers.PATTERN)
