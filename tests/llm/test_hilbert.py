import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import hilbert, queries


def brute(rows, k):
    out = {}
    for q, v in rows.items():
        if q % 20 == 0:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_curve_visits_every_cell_by_unit_steps():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = hilbert.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_query_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got, want = answers(queries.QUERIES["op9_hilbert_neighbours"](spark, folder)), brute(rows, 20)
    assert set(got) == set(want)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    for q, hits in got.items():
        assert len(hits) == 20 and hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        assert all(abs(s - float(np.dot(rows[q], rows[i]))) < 1e-12 for i, s in hits)


def test_many_cells_and_copies(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "STRETCH", 48)
    monkeypatch.setattr(hilbert, "BLOCK", 13)
    r = np.random.default_rng(5)
    rows = {i: np.round(r.standard_normal(8), 3) for i in range(0, 400)}
    for i in range(100, 260):
        rows[i] = rows[100]  # one vector with many copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    got, want = answers(hilbert.search(df, F.col("vec_id") % 20 == 0, reach=0.5)), brute(rows, 20)
    assert {q: [i for i, _ in hits] for q, hits in got.items()} == {q: [i for i, _ in hits] for q, hits in want.items()}


def shares(spark, rows, reach, queries_=None):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>").repartition(4)
    got, want = answers(hilbert.search(df, F.col("vec_id") % 20 == 0, reach=reach)), brute(rows, 20)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_curves_beat_random_orders(spark):
    """Vectors with structure (twelve directions with noise): windows of 6 % on either side find 0.9, random orders of that size about half."""
    r = np.random.default_rng(8)
    centres = r.standard_normal((40, 32))
    rows = {i: centres[i % 40] + 0.25 * r.standard_normal(32) for i in range(4000)}
    rows = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    reach = 0.06
    chance = 1 - (1 - 2 * reach) ** hilbert.CURVES
    assert chance < 0.55 and shares(spark, rows, reach) >= 0.9


def test_an_outlier_shifts_nobody(spark):
    r = np.random.default_rng(9)
    rows = {i: v / np.linalg.norm(v) for i, v in enumerate(r.standard_normal((2000, 32)))}
    plain = shares(spark, rows, hilbert.REACH)
    rows[2001] = 100_000 * rows[7]
    assert plain >= 0.9 and shares(spark, rows, hilbert.REACH) >= 0.9


def test_ids_with_several_vectors_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.1]), (1, [0.9, 0.0]), (2, [0.7, 0.7]), (3, [1.0]), (4, [1.0, 0.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert.search(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(1, 0.9), (2, 0.7), (1, 0.5), (20, 0.0), (20, 0.0)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == 20)[:2] == [(1, 20, 2.0), (1, 20, 2.0)]


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, None]), (7, [2.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, point int")
    got = answers(hilbert.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(7, 2.0), (20, 0.5), (1, 0.0)], 20: [(7, 1.0), (0, 0.5), (1, 0.5)]}
    assert hilbert.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert hilbert.search(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []
