import re
from collections import Counter

import pytest

from pagemill.llm import queries, sharding


def test_table_is_the_turn_taking_one():
    names, slots = ["b", "a", "c"], 101
    order = {s: [(sharding._hash(s, "offset") + j * (sharding._hash(s, "skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in names}
    want, queue = [None] * slots, {s: iter(order[s]) for s in names}
    while None in want:
        for s in sorted(names, key=names.index):
            slot = next((x for x in queue[s] if want[x] is None), None)
            if slot is not None:
                want[slot] = s
    assert [names[i] for i in sharding.lookup_table(names, slots)] == want


def test_balance_weights_and_little_movement():
    names = [f"s{i}" for i in range(20)]
    table = sharding.lookup_table(names, 2003)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved / 2003 < 0.25
    weighted = Counter(sharding.lookup_table(names, 2003, {"s0": 3.0, "s1": 0.0}))
    assert 1 not in weighted and weighted[0] == pytest.approx(3 * weighted[2], rel=0.05)
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_query(spark, tiny, documents):
    df = queries.QUERIES["op4_permutation_shards"](spark, tiny)
    table = sharding.lookup_table(queries.SHARDS)
    got = df.collect()
    assert sorted(r.doc_id for r in got) == [d for d, *_ in documents]
    assert all(r.shard == queries.SHARDS[table[r.slot]] for r in got)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and not re.search("Python|Arrow", plan)


def test_odd_rows(spark, odd, none, rows, tmp_path):
    assert len(sharding.assign(none, ["doc_id"], ["a", "b"], name="to", slot_name="at").collect()) == 0
    placed = sharding.assign(odd, ["doc_id"], ["a", "b"], name="to", slot_name="at")
    assert placed.columns == [*odd.columns, "at", "to"] and placed.count() == len(rows)
    assert placed.select("doc_id", "to").distinct().count() == len({r[0] for r in rows})
    with pytest.raises(ValueError):
        sharding.assign(odd, ["doc_id"], ["a"])
    narrow = placed.select("doc_id", "text", "to")
    sharding.write(narrow, f"{tmp_path}/shards", name="to")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert sum(r.rows for r in sharding.loads(narrow, "to").collect()) == len(rows)
