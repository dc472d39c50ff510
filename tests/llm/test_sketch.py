import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import queries, sketch

ALL = (1 << 64) - 1


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _chain(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    h = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if not h:
        return set()
    if len(h) >= 5:
        shingles = {_chain(h[i : i + 5]) for i in range(len(h) - 4)}
    else:
        whole = 0
        for x in h:
            whole = _signed(_chain([whole, x]))
        shingles = {whole & ALL}
    return {x for x in shingles if x < 1 << 61} or {min(shingles)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    out = []
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        a, b, c = brute(text), brute(edited), brute(after)
        hexed = ["".join("%016x" % x for x in sorted(s)) for s in (a, b)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *hexed, likeness(a, b), likeness(a, c)))
    return out


@pytest.mark.parametrize("ranges", [1, 4])
def test_query(spark, tiny, documents, monkeypatch, ranges):
    monkeypatch.setattr(sketch, "RANGES_PER_PARTITION", ranges)
    got = [tuple(r) for r in queries.QUERIES["op3_scaled_sketch"](spark, tiny).collect()]
    assert sorted(got) == sorted(expected([(d, t) for d, t, *_ in documents]))


def test_odd_rows(odd, none, rows):
    docs = sorted([(r[0], r[1] or "") for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([tuple(r) for r in sketch.compare_edited(odd).collect()], key=order) == sorted(expected(docs), key=order)
    assert sketch.compare_edited(none).collect() == []
    alone = sketch.compare_edited(odd.filter("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_text_moves_once(spark, tiny):
    plan = queries.QUERIES["op3_scaled_sketch"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and not re.search("Python|Arrow|Pandas", plan)


def test_merge_and_containment(spark):
    left, right = (" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 400), (300, 380)))
    both = left + " " + " ".join(f"w{i}" for i in range(396, 398))
    df = spark.createDataFrame([(left, right, both)], "a string, b string, c string")
    s = {c: sketch.sketch(F.col(c)) for c in "abc"}
    row = df.select(
        sketch.merge(s["a"], s["b"]).alias("m"), s["a"].alias("a"), s["b"].alias("b"), sketch.containment(s["b"], s["a"]).alias("inside"), sketch.containment(s["a"], s["b"]).alias("covers")
    ).first()
    assert row.m == sorted(set(row.a) | set(row.b)) and row.inside == 1.0 and 0.05 < row.covers < 0.4
