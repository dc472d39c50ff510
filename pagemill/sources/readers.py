"""Readers with declared schemas: no inference passes over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagemill import schemas
from pagemill.functions import urls
from pagemill.functions.common import unnest
from pagemill.sources.files import utf8_json, whole_files


def page_corpus(spark: SparkSession, path: str, html_files: bool = False) -> DataFrame:
    """(url, html) pages from Parquet, or one page per HTML file at ``path`` or in its folders, with the file's path as URL.

    Tasks list and read a folder. Single files, a pattern such as ``folder/*/*.html`` and packed files go through Spark's reader, whose driver holds their names.
    """
    if not html_files:
        return spark.read.parquet(path)
    read = lambda at: spark.read.text(at, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    found = whole_files(spark, path)
    if found is None:
        return read(path)
    content, packed = found
    pages = content.select("url", F.col("content").cast("string").alias("html"))
    return pages.unionByName(read(packed)) if packed else pages


def crawl_results(spark: SparkSession, path: str, lines: bool = False, folders: bool = False) -> DataFrame:
    """Crawl results: one pretty-printed JSON object per file, or with ``lines`` one per line.

    With ``folders`` the files of one object also lie in folders of the path, and tasks list and read them, as in :func:`page_corpus`.
    """
    reader = spark.read.schema(schemas.CRAWL_RESULT).option("multiLine", not lines)
    if folders:
        reader = reader.option("recursiveFileLookup", True)
    found = whole_files(spark, path, utf8_json) if folders and not lines else None
    if found is None:
        return reader.json(path)
    content, packed = found
    texts = content.select(F.col("content").cast("string").alias("value"))
    texts = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    parsed = DataFrame(spark.read.schema(schemas.CRAWL_RESULT)._jreader.json(texts), spark)  # by the parser that reads files
    return parsed.unionByName(reader.json(packed)) if packed else parsed


def crawl_pages(results: DataFrame) -> DataFrame:
    """The pages of crawl results, one row each."""
    return unnest(results, ["base_url"], "pages", "page").select("base_url", "page.*")


def structured_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-line logs; fields a line lacks are null."""
    return spark.read.schema(schemas.LOG).json(path)


def submissions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Submitted documents checked against the schema: ``problem`` is null for good ones.

    Works on batch and streaming input alike. A document needs a valid URL, a title
    and both lists; JSON that does not fit the schema is a problem, not a failure.
    """
    schema = schemas.SUBMISSION + ", _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    read = lines.withColumn("_doc", F.from_json(F.col(column), schema, options))
    doc = F.col("_doc")
    missing = [F.when(doc[name].isNull(), F.lit(f"missing {name}")) for name in ("url", "title", "headings", "paragraphs")]
    problem = F.coalesce(
        F.when(doc.isNull() | doc["_corrupt"].isNotNull(), "malformed JSON"),
        *missing,
        F.when(~urls.is_valid_url(doc["url"]), "invalid URL"),
    )
    fields = [doc[name].alias(name) for name in ("url", "title", "headings", "paragraphs")]
    keep = [c for c in lines.columns if c != column]
    return read.select(*keep, F.col(column).alias("raw"), problem.alias("problem"), *fields)


def good_and_bad(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = checked.filter(F.col("problem").isNull()).drop("problem", "raw")
    return good, checked.filter(F.col("problem").isNotNull()).select(*[c for c in checked.columns if c not in ("url", "title", "headings", "paragraphs")])


def with_iso_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Metric times arrive as ISO text; compare them as timestamps."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column)))


def metric_entry(task_id: Column, metrics: Column, at: Column) -> Column:
    """A metric row from a map of arbitrary keys; unknown keys stay in ``extra``."""
    known = ["status", "duration", "response_time"]
    return F.struct(
        task_id.cast("string").alias("task_id"), at.alias("timestamp"), metrics["status"].alias("status"),
        metrics["duration"].try_cast("double").alias("duration"), metrics["response_time"].try_cast("double").alias("response_time"),
        F.map_filter(metrics, lambda k, _: ~k.isin(known)).alias("extra"),
    )
