"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point alone. A letter trigram is the product of its
letters' vectors, rotated by two, one and no places; a text's vector is the sum over its trigrams; a language's
prototype is the sum of its training texts' unit vectors, seen from the mean of all languages. The nearest prototype by cosine wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

DIMENSIONS = 1024
PER_LANGUAGE = 1_500  # training documents per language at most, the smallest by a hash of their id
LANGUAGES = 4_096  # label values at most; beyond it training is refused
SLAB = 4_096  # trigrams whose vectors are held at once
PIECE = 1 << 20  # code points read at a time
SHARPNESS = 24.0  # turns cosines into shares
SEED = 20_177
UNKNOWN = "und"


def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1


class Letters:
    """Code points -> compact letter numbers (0: anything else), and the trigram vectors."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.number = np.full(0x110000, -1, np.int32)  # -1: not met yet
        self.vectors = [_letter_vector(0x20, dimensions)]
        self.kept: dict[int, np.ndarray] = {}

    def _learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes).tolist():
            if chr(code).isalpha():
                self.number[code] = len(self.vectors)
                self.vectors.append(_letter_vector(code, self.dimensions))
            else:
                self.number[code] = 0

    def trigrams(self, text: str) -> np.ndarray:
        """Keys of the text's trigrams: letters in lower case, every run of anything else as one gap, gaps at the ends."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        numbers = self.number[codes]
        if (new := numbers < 0).any():
            self._learn(codes[new])
            numbers = self.number[codes]
        numbers = np.concatenate(([0], numbers, [0]))
        stay = np.ones(len(numbers), bool)
        stay[1:] = (numbers[1:] != 0) | (numbers[:-1] != 0)
        numbers = numbers[stay].astype(np.int64)
        if len(numbers) < 3:
            return np.zeros(0, np.int64)
        return numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """Trigram vectors, a row per key."""
        letters = np.stack(self.vectors)
        mask = (1 << 21) - 1
        first, second, third = (letters[(keys >> s) & mask] for s in (42, 21, 0))
        return (np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third).astype(np.float32)


def encode_texts(letters: Letters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One unit vector per text (zero without letters), and whether it has a letter."""
    vectors, grams = _encode(letters, texts)
    return vectors, grams > 0


def _encode(letters: Letters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One unit vector per text and its number of different trigrams."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(text or ""), PIECE):
            part = letters.trigrams(text[max(at - 2, 0) : at + PIECE])
            new, n = np.unique(part, return_counts=True)
            if not len(keys):
                keys, counts = new, n
            else:
                keys, where = np.unique(np.concatenate((keys, new)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((counts, n)), len(keys)).astype(np.int64)
        found.append((keys, counts))
    out = np.zeros((len(texts), letters.dimensions), np.float32)
    sizes = [len(k) for k, _ in found]
    if not sum(sizes):
        return out, np.zeros(len(texts), np.int64)
    vocabulary, column = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), sizes)
    weight = np.concatenate([c for _, c in found]).astype(np.float32)
    for at in range(0, len(vocabulary), SLAB):
        inside = (column >= at) & (column < at + SLAB)
        table = np.zeros((len(texts), min(SLAB, len(vocabulary) - at)), np.float32)
        table[row[inside], column[inside] - at] = weight[inside]
        out += table @ letters.bound(vocabulary[at : at + SLAB])
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1), np.array(sizes)


_LETTERS: dict[int, Letters] = {}


def _letters(dimensions: int) -> Letters:
    if dimensions not in _LETTERS:
        _LETTERS[dimensions] = Letters(dimensions)
    return _LETTERS[dimensions]


def _slices(batch: pa.RecordBatch, column: int, size: int = 128):
    """Short runs of rows, so that a batch of long texts needs bounded memory."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, part.column(column).to_pylist()


def train(docs: DataFrame, training: Column, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Language labels in order and their prototypes, from rows where ``training`` holds and ``lang`` is not null.

    The sample is bounded: the ``per_language`` smallest ids by hash of every label. Vectors are summed per task
    and label; what reaches the driver is one vector per label. Without any labelled row the lists are empty.
    """
    narrow = docs.filter(training & F.col("lang").isNotNull()).select("doc_id", "lang").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ranked = narrow.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    sample = ranked.filter(F.col("r") <= per_language).select("doc_id", "lang").collect()
    if len({row["lang"] for row in sample}) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} language labels")
    if not sample:
        return [], np.zeros((0, dimensions), np.float32)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], r["lang"]) for r in sample], "doc_id long, lang string")
    rows = docs.filter(training).select("doc_id", "lang", "text")
    rows = rows.join(F.broadcast(chosen), (rows.doc_id.eqNullSafe(chosen.doc_id)) & (rows.lang == chosen.lang), "left_semi")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _letters(dimensions), {}
        for batch in batches:
            for part, texts in _slices(batch, 1):
                vectors, _ = encode_texts(letters, texts)
                for label, vector in zip(part.column(0).to_pylist(), vectors):
                    if label in sums:
                        sums[label] += vector
                    else:
                        sums[label] = vector.astype(np.float64)
        yield pa.record_batch(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "vector"],
        )

    parts = rows.select("lang", "text").mapInArrow(bundle, "lang string, vector array<double>")
    at = parts.select("lang", F.posexplode("vector").alias("place", "v")).groupBy("lang", "place").agg(F.sum("v").alias("v"))
    total = at.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("vector")).orderBy("lang").collect()
    labels = [r["lang"] for r in total]
    prototypes = np.array([[p["v"] for p in r["vector"]] for r in total]).reshape(len(labels), dimensions)
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return labels, prototypes


def predict(docs: DataFrame, labels: list[str], prototypes: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns named in ``keep`` with ``lang_pred``, ``score``, ``cosine`` and ``grams`` from the text alone, in one pass without shuffle.

    ``und`` with score and cosine 0 where the text is null, has no letter, or no language was learned. Ties go to the first label.
    ``score`` is the winner's share of all cosines' exponentials, 0 to 1; ``cosine`` is that of the text and the winner's prototype as
    they are, which tells a text far from every learned language; ``grams`` counts its different trigrams. Texts of any length are read whole, a piece at a time. Columns of
    ``docs`` named like a new one must not be kept.
    """
    keep = ["doc_id"] if keep is None else keep
    dimensions = prototypes.shape[1]
    middle = prototypes.mean(axis=0) if len(labels) > 1 else np.zeros(dimensions)
    seen = prototypes - middle
    seen = (seen / np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    middle = middle.astype(np.float32)
    whole = prototypes.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters(dimensions)
        for batch in batches:
            for part, texts in _slices(batch, part_text):
                if labels:
                    vectors, grams = _encode(letters, texts)
                    has = grams > 0
                    plain = vectors @ whole.T
                    vectors = vectors - middle
                    cosine = vectors @ seen.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                    best = cosine.argmax(axis=1)
                    share = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                    score = np.where(has, 1 / share.sum(axis=1), 0.0)
                    near = np.where(has, plain[np.arange(len(texts)), best], 0.0)
                    names = [labels[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), has.tolist())]
                else:
                    names, score, near = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                    grams = np.zeros(len(texts), np.int64)
                columns = [part.column(i) for i in range(part.num_columns) if i != part_text or text_stays]
                said = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.float64()), pa.array(grams, pa.int64())]
                yield pa.record_batch([*columns, *said], names=out)

    text_stays = "text" in keep
    chosen = docs.select(*keep) if text_stays else docs.select(*keep, "text")
    part_text = chosen.columns.index("text")
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string", "score double", "cosine double", "grams long"])
    out = [*keep, "lang_pred", "score", "cosine", "grams"]
    return chosen.mapInArrow(run, schema)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row; learns from rows outside fold 2 of 4.

    Repeated rows come back repeated; an empty table gives no rows.
    """
    held_out = fold("doc_id", 4) == 2
    labels, prototypes = train(docs, ~held_out)
    return predict(docs, labels, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


FAR = 0.1  # three standard deviations of the cosine of unrelated vectors of 1,024 dimensions
GRAMS_TO_JUDGE = 50  # a text of fewer different trigrams is never called far
CERTAIN = 0.95  # score at which a prediction overrules a label


def relabel(docs: DataFrame, far: float = FAR, certain: float = CERTAIN) -> DataFrame:
    """The documents in a learned language, with all columns; ``lang`` becomes the prediction where it is null or a sure prediction contradicts it.

    Rejected are null texts, texts without a letter, and texts of at least ``GRAMS_TO_JUDGE`` different trigrams whose cosine with the nearest
    language is below ``far``. Without a labelled row nothing can be learned: texts with a letter stay as they are. Repeated rows come
    back repeated; an empty table gives no rows; further columns stay, also if named like an intermediate.
    """
    labels, prototypes = train(docs, F.lit(True))
    if not labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    plain = {c: "text" if c == "text" else f"_column{i}" for i, c in enumerate(docs.columns)}  # no name meets a new one
    renamed = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in plain.items()])
    found = predict(renamed, labels, prototypes, keep=list(plain.values()))
    strange = (F.col("cosine") < far) & (F.col("grams") >= GRAMS_TO_JUDGE)
    label = F.col(plain["lang"])
    lang = F.when(label.isNull() | (F.col("score") >= certain), F.col("lang_pred")).otherwise(label)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & ~strange)
    return kept.select(*[(lang if c == "lang" else F.col(name)).alias(c) for c, name in plain.items()])
