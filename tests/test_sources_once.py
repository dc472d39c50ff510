from pyspark.sql import functions as F

from pagemill.sources import readers, writers


def test_export_computes_its_items_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def build(doc):
        made.add(1)
        return [{"title": f"t{doc}"}]

    docs = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("id"), F.udf(build, "array<struct<title:string>>")("id").alias("data"))
    wanted = spark.range(40).select((-F.col("id")).alias("position"), F.col("id").cast("string").alias("id"))
    assert writers.export(wanted, docs, "json", "7", str(tmp_path)).first().record_count == 40
    assert made.value == 40


def test_html_files_are_found_in_folders(spark, tmp_path):
    for at in ("a/b", "c"):
        (tmp_path / at).mkdir(parents=True)
        (tmp_path / at / "p.html").write_text(f"<p>{at}\nend")
    assert {r.html for r in readers.page_corpus(spark, str(tmp_path), html_files=True).collect()} == {"<p>a/b\nend", "<p>c\nend"}
