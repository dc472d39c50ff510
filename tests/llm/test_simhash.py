import numpy as np
import xxhash

from pagemill.llm import graph, queries, simhash


def fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, radius=4):
    """Brute force: (id, fingerprint) -> smallest id reachable."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, fp, least.get(find(i))) for i, (key, fp) in enumerate(items)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_query(spark, tiny, documents):
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.QUERIES["op1_simhash_groups"](spark, tiny).collect()]
    assert sorted(got) == sorted(groups([(d, fingerprint(t)) for d, t, *_ in documents]))


def test_odd_rows(odd, none, rows):
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_groups(odd).collect()]
    assert order(got) == order(groups([(r[0], fingerprint(r[1])) for r in rows]))
    assert simhash.near_groups(none).collect() == [] and simhash.keep_one(none).collect() == []
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # 1 and 2 agree, 3 (null), 4 and 5 have no words; 3 also names another text.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0)]


def test_one_row_of_each_group(spark):
    """Null, shared and repeated ids: one row per group, that of the least id where there is one."""
    a, b, c = [" ".join(f"{x}{i}" for i in range(400)) for x in "abc"]
    near = lambda text: text + " z"
    assert all(0 < (fingerprint(t) ^ fingerprint(near(t))).bit_count() <= 4 for t in (a, b, c))
    rows = [(None, a), (None, a), (None, near(a)), (5, near(b)), (None, b), (None, b), (7, c), (3, near(c)), (3, near(c)), (3, a.upper() + " y x"), (None, None), (None, "")]
    rows += [(9, "one two"), (9, "ONE two"), (9, "one two")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [(d, fingerprint(t), t) for d, t in rows]
    find, want = connected([(p, q) for _, p, _ in prints for _, q, _ in prints if (p ^ q).bit_count() <= 4]), {}
    for d, p, t in prints:
        want.setdefault(find[p], []).append((d, t))
    assert len(got) == len(want)
    for members in want.values():
        (kept,) = [(r.doc_id, r.text) for r in got if (r.doc_id, r.text) in members]
        assert kept[0] == min((d for d, _ in members if d is not None), default=None)


def test_long_text_in_pieces(monkeypatch, rows):
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert simhash.text_fingerprint(rows[7][1].encode()) & (2**64 - 1) == fingerprint(rows[7][1])


def pairs(fps, radius):
    return {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if (int(a) ^ int(b)).bit_count() <= radius}


def connected(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def cloud(n, seed=1, flips=3):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, 12, dtype=np.uint64)
    out = set()
    while len(out) < n:
        x = int(base[r.integers(0, 12)])
        for b in r.integers(0, 64, r.integers(0, flips + 1)):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def test_bit_slices():
    fps = cloud(600)
    for radius in (0, 1, 3, 4, 7):
        a, b = simhash.bucket_links(np.zeros(len(fps), np.int64), fps.view(np.int64), radius)
        got = [(int(x) & (2**64 - 1), int(y) & (2**64 - 1)) for x, y in zip(a, b)]
        assert set(tuple(sorted(p)) for p in got) <= pairs(fps.tolist(), radius)
        assert connected(got) == connected(pairs(fps.tolist(), radius))


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 20)
    monkeypatch.setattr(simhash, "FLUSH", 50)
    fps = cloud(400)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    placed = simhash.buckets(df, 4)
    assert placed.groupBy("block", "g1", "sub", "g2", "tile").count().agg({"count": "max"}).first()[0] < 100
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(df, 4).collect()]
    assert connected(got) == connected(pairs(fps.tolist(), 4))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 130)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
