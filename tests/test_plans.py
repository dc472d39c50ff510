"""Ordered and skewed plans against brute force, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.plans import ordered, skew, stored


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randint(0, 20)}", rng.randint(0, 40), rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, k string, t long, v double").repartition(7)


def grouped(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


ORDER = lambda: [F.col("t").asc(), F.col("id").asc()]


def test_row_index(skewed):
    rows, df = skewed
    got = {r.id: r.row_index for r in ordered.row_index(df, ORDER(), ["k"]).collect()}
    assert got == {r[0]: i for group in grouped(rows).values() for i, r in enumerate(group)}
    total = {r.id: r.n for r in ordered.row_index(df, ORDER(), name="n").collect()}
    assert total == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}


def test_running_totals(skewed):
    rows, df = skewed
    got = {r.id: (r.s, r.at) for r in ordered.running_totals(df, ORDER(), {"t": "s"}, ["k"], index="at").collect()}
    for group in grouped(rows).values():
        for i, total in enumerate(np.cumsum([r[2] for r in group])):
            assert got[group[i][0]] == (total, i)


@pytest.mark.parametrize("segment", [61, 500, 50_000])
def test_trailing_window(skewed, segment):
    rows, df = skewed
    out = ordered.trailing_window(df, ORDER(), 60, {"m": F.avg("v"), "n": F.count("*")}, ["k"], segment)
    got = {r.id: (r.m, r.n) for r in out.collect()}
    assert len(got) == len(rows)
    for group in grouped(rows).values():
        values = [r[3] for r in group]
        for i, row in enumerate(group):
            frame = values[max(0, i - 59): i + 1]
            assert got[row[0]] == (pytest.approx(np.mean(frame)), len(frame))


def test_exact_percentiles(skewed):
    rows, df = skewed
    got = {r.k: (r.m, r.p) for r in ordered.exact_percentiles(df, "t", {"m": 0.5, "p": 0.95}, ["k"]).collect()}
    for key, group in grouped(rows).items():
        values = [r[2] for r in group]
        assert got[key] == (pytest.approx(np.percentile(values, 50)), pytest.approx(np.percentile(values, 95)))
    whole = ordered.exact_percentiles(df, "v", {"q": 0.123}).first()
    assert whole.q == pytest.approx(np.percentile([r[3] for r in rows], 12.3))
    assert ordered.exact_percentiles(df.filter("false"), "v", {"q": 0.5}).first().q is None


def test_hot_key_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 2_500)
    many = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    one = many.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    joined = skew.join_on_hot_key(many, one, "key", "n", "id")
    assert joined.count() == 60_000
    assert joined.filter("key = 'hot'").agg(F.min("first"), F.max("first"), F.count("*")).first()[:] == (0, 0, 20_000)
    spread = joined.filter("key = 'hot'").select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("s")).distinct().count()
    assert spread == 8


def test_materialize_uses_the_shared_folder(spark):
    df = stored.materialize(spark.range(5), "x")
    assert spark.conf.get("spark.checkpoint.dir") in df.inputFiles()[0]
    assert df.count() == 5
    other = stored.fresh_path(spark, "gone")
    spark.range(2).write.parquet(other)
    assert stored.exists(spark, other) and "_SUCCESS" in stored.list_names(spark, other)
    stored.delete_folder(spark, other)
    assert stored.list_names(spark, other) == []
    with pytest.raises(Exception):
        spark.read.parquet(other)


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stored.shared_folder(Session())


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, "a", 5.0)], "id long, k string, v double")
    assert {r.id: r.row_index for r in ordered.row_index(df, [F.col("id").asc()], ["k"]).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r.k: r.m for r in ordered.exact_percentiles(df, "v", {"m": 0.5}, ["k"]).collect()} == {None: 2.0, "a": 5.0}
    one = df.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted((r.id, r.n) for r in skew.join_on_hot_key(df, one, "k", "n", "id").collect()) == [(1, 2), (2, 2), (3, 1)]
