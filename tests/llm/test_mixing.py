from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixing, queries


def fill(budget, children):
    """Brute force: children as (room, weight), shortages going to the others by weight, round by round."""
    given = [0.0] * len(children)
    open_ = [i for i, (room, weight) in enumerate(children) if room > 0 and weight > 0]
    left = min(budget, sum(children[i][0] for i in open_))
    while left > 1e-9 and open_:
        shares = sum(children[i][1] for i in open_)
        parts = {i: min(children[i][0] - given[i], left * children[i][1] / shares) for i in open_}
        for i, x in parts.items():
            given[i] += x
        left -= sum(parts.values())
        open_ = [i for i in open_ if children[i][0] - given[i] > 1e-9]
    return given


LEAVES = [
    ("web", "en", "a", 1000), ("web", "en", "b", 50), ("web", "de", "c", 200), ("web", "fr", "d", 10), ("book", "en", "e", 300), ("book", "en", "f", 300),
    ("book", "de", "g", 5), ("code", "en", "h", 70),
]
WEIGHTS = {("web",): 3.0, ("book",): 2.0, (None, "en"): 2.0, ("book", "en", "f"): 0.0}


def brute(total, epochs):
    weight = lambda path: next((w for p, w in WEIGHTS.items() if len(p) == len(path) and all(a is None or a == b for a, b in zip(p, path))), 1.0)
    room = {path[:3]: path[3] * epochs * (weight(path[:3]) > 0) for path in LEAVES}

    def down(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = sorted({p[len(prefix)] for p in room if p[: len(prefix)] == prefix})
        paths = [(*prefix, n) for n in names]
        rooms = [sum(r for p, r in room.items() if p[: len(q)] == q) for q in paths]
        out = {}
        for q, given in zip(paths, fill(budget, list(zip(rooms, map(weight, paths))))):
            out |= down(q, given)
        return out

    return down((), total)


@pytest.mark.parametrize("total, epochs", [(0, 1), (100, 1), (600, 1), (1500, 1), (9999, 1), (2000, 3)])
def test_budgets(spark, total, epochs):
    leaves = spark.createDataFrame(LEAVES, "domain string, language string, origin string, tokens long")
    got = mixing.budgets(leaves, ["domain", "language", "origin"], total, WEIGHTS, epochs).collect()
    assert {(r.domain, r.language, r.origin): pytest.approx(r.budget, abs=1e-6) for r in got} == brute(total, epochs)


def test_query(spark, tiny, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op7_source_mixture"](spark, tiny).collect()}
    assert sorted(got) == [d for d, *_ in documents]
    leaves, used = defaultdict(int), defaultdict(int)
    for d, text, lang, source in documents:
        r = got[d]
        assert r.n_tokens == len(text.encode().split()) + 1 and (r.language, r.origin) == (lang, source) and 0 <= r.copies <= 4
        leaves[r.domain, lang, source] += r.n_tokens
        used[r.domain, lang, source] += r.n_tokens * r.copies
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, language string, origin string, tokens long")
    want = mixing.budgets(df, ["domain", "language", "origin"], float(sum(leaves.values())), {("domain0",): 2.0, (None, "en"): 2.0}, 4.0).collect()
    for r in want:
        key = (r.domain, r.language, r.origin)
        longest = max(got[d].n_tokens for d, _, lang, source in documents if (got[d].domain, lang, source) == key)
        assert abs(used[key] - r.budget) <= longest / 2 + 1e-6
        assert len({got[d].copies for d, _, lang, source in documents if (got[d].domain, lang, source) == key}) <= 2


def test_seeds_change_the_choice_only(spark, documents):
    df = spark.createDataFrame([(d, t, s) for d, t, _, s in documents], "doc_id long, text string, source string")
    picks = [{r.doc_id for r in mixing.mix(df, {"one": F.lit("x")}, share=0.5, seed=s).filter("copies > 0").collect()} for s in (1, 1, 2)]
    assert picks[0] == picks[1] != picks[2]


def test_odd_rows(odd, none, rows):
    levels = {"_l": F.col("lang"), "_s": F.col("source")}
    with pytest.raises(ValueError):
        mixing.mix(odd, levels, share=1.0)
    docs = odd.drop("copies", "n_tokens")
    got = mixing.mix(docs, levels, share=1.0).collect()
    assert len(got) == len(rows) and all(r.copies == 1 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5)} == {1}
    assert all(r.copies == 0 for r in mixing.mix(docs, levels, total=0.0).collect())
    assert mixing.mix(none.drop("copies", "n_tokens"), levels, share=1.0).collect() == []
