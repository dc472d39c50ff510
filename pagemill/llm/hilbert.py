"""Nearest vectors by inner product, over several shifted Hilbert orderings.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance. Each ordering rotates them at random,
shifts a few projected coordinates and orders them along a Hilbert curve. Spark range-partitions every ordering; a query
is compared with the vectors whose ranks lie within its window of each curve, and the curves' answers merge and are ranked by the exact measure.

Ranks are cut into stretches of fixed length. A task holds the queries of one stretch with their best answers so far, and the candidates
within reach stream past in blocks, so its memory is fixed whatever the table's size, and a query leaves one short list per curve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagemill.plans.ordered import row_index
from pagemill.plans.stored import materialize

CURVES = 6
AXES, BITS = 6, 8  # projected coordinates of a curve, and bits of each
REACH = 0.2  # share of the distinct vectors on either side of a query's rank that its window holds
STRETCH = 65_536  # ranks whose queries are answered together
BLOCK = 1_024  # candidates compared at a time
QUANTILES = 65  # marks along each projected coordinate
SEED = 90_001


def rotations(width: int, curves: int, axes: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Per curve, orthonormal projections (curves, width, axes) and shifts in -0.5..0.5 of the range."""
    r = np.random.default_rng([seed, width])
    count = min(axes, width)
    planes = np.stack([np.linalg.qr(r.standard_normal((width, count)))[0] for _ in range(curves)])
    return planes, r.random((curves, count)) - 0.5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points (rows) with coordinates of ``bits`` bits.

    The transposed form is built from the highest bit down: each level undoes the rotation that the levels above imply, and a Gray code follows.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(axes):
            set_ = (x[i] & level) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where((x[axes - 1] & level) != 0, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(axes):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of rows that take part: no null, zero, null or non-finite components; rows that are alike in both count once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).distinct()


def cells_of(projected: np.ndarray, marks: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Cells by the share of all vectors below a coordinate (``marks`` are its quantiles), moved by ``shift`` of the range."""
    share = np.linspace(0, 1, marks.shape[1])
    below = np.column_stack([np.interp(projected[:, i], marks[i], share) for i in range(len(marks))])
    return np.clip((below * 0.75 + 0.125 + shift / 4) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    curves: int = CURVES,
    reach: float = REACH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row where ``is_query`` holds, its ``k`` nearest found among all other rows.

    ``is_query`` is a condition on ``vec_id``. Rows of equal vectors are one point of the curves, so copies crowd nothing out: a
    found point stands for its smallest ids. Rows that take no part are named in ``usable``; vectors of another length than most (of
    two equally common lengths, than the greater) take none either. Rows of one id and several vectors are rows like any other: each asks
    for itself and is a candidate for the others. Cells follow the quantiles of each projected coordinate, so a vector of huge norm
    shifts nobody else. Ties go to the smaller id. A table without queries, or of one row, gives no rows. Further columns are dropped,
    whatever their names.
    """
    rows = usable(vectors, id_col, vector_col)
    place = Window.partitionBy("point").orderBy("vec_id")
    rows = materialize(rows.select("vec_id", F.xxhash64(F.lit(SEED), "v").alias("point"), "v"), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    lengths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(square).alias("top"))
    common = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if common is None:
        return empty
    width, top = common["width"], float(common["top"])
    rows = rows.filter(F.size("v") == width)
    points = materialize(rows.groupBy("point").agg(F.min("v").alias("v"), F.max(is_query).alias("asks")), "points")
    n = points.count()
    members = rows.select("point", "vec_id").withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= k + 1)
    planes, shifts = rotations(width + 1, curves, AXES)  # at most AXES coordinates of a curve

    def lifted(v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))
        return np.column_stack((v, rest)) / np.sqrt(top)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = lifted(_matrix(batch.column(0), width))
                yield pa.RecordBatch.from_arrays([pa.array(v @ planes[c][:, i]) for c in range(curves) for i in range(planes.shape[2])], names=coordinates)

    coordinates = [f"c{n}" for n in range(curves * planes.shape[2])]
    shares = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    quantiles = points.select("v").mapInArrow(projected, ", ".join(f"{c} double" for c in coordinates))
    marks = quantiles.agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c in coordinates]).first()  # numbers whose count is fixed
    marks = np.array([marks[c] for c in coordinates]).reshape(curves, planes.shape[2], QUANTILES)
    # Equal marks (a coordinate that most vectors share) would leave the interpolation undefined.
    marks = marks + np.arange(QUANTILES) * 1e-12 * np.maximum(np.abs(marks).max(axis=2, keepdims=True), 1e-300)

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = lifted(_matrix(batch.column(1), width))
            for c in range(curves):
                cells = cells_of(v @ planes[c], marks[c], shifts[c])
                keys = hilbert_keys(cells, BITS)
                yield pa.record_batch([pa.array(np.full(len(keys), c), pa.int32()), pa.array(keys, pa.int64()), batch.column(0)], names=["curve", "key", "point"])

    keyed = materialize(points.select("point", "v").mapInArrow(key_rows, "curve int, key long, point long"), "hilbert-keys")
    ranked = row_index(keyed, [F.col("key"), F.xxhash64("curve", "point"), F.col("point")], ["curve"], "at")
    window = min(n, 2 * int(np.ceil(reach * n)) + 1)
    # The window keeps its size at both ends of a curve.
    low = F.greatest(F.lit(0), F.least(F.col("at") - window // 2, F.lit(n - window))).cast("long")
    ranked = ranked.join(points, "point").select("curve", "at", "point", "v", "asks", low.alias("low"))
    ranked = materialize(ranked, "hilbert-ranked")
    stretch = lambda at: F.floor(at / STRETCH).cast("long")
    queries = ranked.filter("asks").select("curve", stretch(F.col("at")).alias("stretch"), F.lit(0).alias("turn"), "at", "low", "point", "v")
    behind = F.greatest(F.lit(0).cast("long"), stretch(F.col("at") - window))
    ahead = F.least(F.lit((n - 1) // STRETCH).cast("long"), stretch(F.col("at") + window))
    candidates = ranked.select("curve", F.explode(F.sequence(behind, ahead)).alias("stretch"), F.lit(1).alias("turn"), "at", "low", "point", "v")
    work = queries.union(candidates).repartition("curve", "stretch").sortWithinPartitions("curve", "stretch", "turn", "at")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, []  # of the current stretch; queries come first
        query = low = value = ids = asker = None

        def settled() -> Iterator[pa.RecordBatch]:
            if value is not None:
                keep = value > -np.inf
                who = np.repeat(asker, value.shape[1]).reshape(value.shape)
                yield pa.record_batch([pa.array(who[keep]), pa.array(ids[keep]), pa.array(value[keep])], names=["asker", "point", "near"])

        for batch in batches:
            if not batch.num_rows:
                continue
            curve, part, turn, at, lows, points_ = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            v = _matrix(batch.column(6), width)
            change = (curve[1:] != curve[:-1]) | (part[1:] != part[:-1]) | (turn[1:] != turn[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(curve)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if key != (curve[a], part[a]):
                    yield from settled()
                    key, asked, value = (curve[a], part[a]), [], None
                if turn[a] == 0:
                    asked.append((v[a:b], lows[a:b], points_[a:b]))
                    continue
                if not asked:
                    continue
                if value is None:
                    query, low, asker = (np.concatenate(x) for x in zip(*asked))
                    value, ids = np.full((len(asker), k + 1), -np.inf), np.zeros((len(asker), k + 1), np.int64)
                for i in range(a, b, BLOCK):
                    block = slice(i, min(i + BLOCK, b))
                    # Candidates come by rank: queries whose window lies wholly before or after the block are passed over.
                    rows = np.flatnonzero((low <= at[block.stop - 1]) & (low + (window - 1) >= at[i]))
                    if not len(rows):
                        continue
                    scores = query[rows] @ v[block].T
                    scores[(at[block] < low[rows][:, None]) | (at[block] > low[rows][:, None] + (window - 1))] = -np.inf
                    every = np.concatenate((value[rows], scores), axis=1)
                    names = np.concatenate((ids[rows], np.broadcast_to(points_[block], scores.shape)), axis=1)
                    best = np.argpartition(-every, k, axis=1)[:, : k + 1]
                    value[rows], ids[rows] = np.take_along_axis(every, best, axis=1), np.take_along_axis(names, best, axis=1)
        yield from settled()

    hits = work.mapInArrow(nearest, "asker long, point long, near double").groupBy("asker", "point").agg(F.max("near").alias("near"))
    # A point that shares the k-th place by value may hold smaller ids: equal values are kept together by rank().
    top_points = hits.withColumn("r", F.rank().over(Window.partitionBy("asker").orderBy(F.desc("near")))).filter(F.col("r") <= k + 1)
    pairs = top_points.select("asker", "point").join(members.select("point", "vec_id"), "point")
    values = points.select(F.col("point").alias("asker"), F.col("v").alias("q"))
    pairs = pairs.join(values, "asker").join(points.select("point", "v"), "point")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("ij,ij->i", _matrix(batch.column(2), width), _matrix(batch.column(3), width))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score), batch.column(4)], names=["asker", "vec_id", "score", "point"])

    scored = pairs.select("asker", "vec_id", "q", "v", "point").mapInArrow(exact, "asker long, vec_id long, score double, point long")
    # k + 1 per distinct query vector suffice: each of its rows leaves out itself alone.
    order = [F.desc("score"), F.asc("vec_id")]
    short = scored.withColumn("r", F.row_number().over(Window.partitionBy("asker").orderBy(*order))).filter(F.col("r") <= k + 1).drop("r")
    askers = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("point").alias("asker"))
    out = askers.join(materialize(short, "short-lists"), "asker").filter("query_id != vec_id OR asker != point")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "asker").orderBy(*order)))
    return out.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
