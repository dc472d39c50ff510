"""Conversation repair against a plain search over all edits, and over segments of any size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import turn_repair
from pagemill.llm.turn_repair import Lattice

SPACES = " \t\n\x0b\x0c\r"


def broken(rows):
    """(conv, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        plain = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """Fault per row of one conversation in order."""
    out, seen = [], set()
    for role, text in rows:
        worn = text.strip(SPACES)
        out.append("blank" if not worn else "duplicate" if (role, text) in seen else "truncated" if worn[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, least audit) by relaxing all edits over (row, last initial) until nothing changes."""
    best = {(0, ""): (0, "")}
    can = {"": "su", "s": "u", "u": "a", "a": "u"}
    for at in range(len(rows) + 1):
        for _ in range(3):  # inserted turns at this place
            for state in ("", "s", "u", "a"):
                if (at, state) in best:
                    cost, audit = best[at, state]
                    for say in can[state].replace("s", ""):
                        label = (cost + 5, audit + "I")
                        best[at, say] = min(best.get((at, say), label), label)
        if at == len(rows):
            break
        for state in ("", "s", "u", "a"):
            if (at, state) not in best:
                continue
            cost, audit = best[at, state]
            options = [(2, "D", state)]
            if marks[at] not in ("blank", "duplicate"):
                extra = 5 if marks[at] == "truncated" else 0
                if rows[at][0][:1] and rows[at][0][0] in can[state]:
                    options.append((extra, "K", rows[at][0][0]))
                options += [(1 + extra, "R", say) for say in can[state].replace("s", "")]
            for step, letter, new in options:
                label = (cost + step, audit + letter)
                best[at + 1, new] = min(best.get((at + 1, new), label), label)
    return min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)


def spoken(rows, audit):
    out, at = [], 0
    for letter in audit:
        next_role = "assistant" if out and out[-1][0][0] == "u" else "user"
        if letter == "I":
            out.append((next_role, ""))
        elif letter == "K":
            out.append(rows[at])
        elif letter == "R":
            out.append((next_role, rows[at][1]))
        at += letter != "I"
    return out


def by_hand(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in broken(rows):
        said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        kept[conv].append((turn is not None, turn or 0, said, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        ordered = sorted(kept[conv])
        turns, said = {t for known, t, *_ in ordered if known}, [(role, text) for *_, role, text in ordered]
        marks = faults(said)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        cost, audit = cheapest(said, marks)
        lines = spoken(said, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in lines))
        text = "\n".join(f"{role}:{text}" for role, text in lines)
        out.append(
            (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")])
            + (sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
        )
    return sorted(out, key=repr)


def found(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, n=1500):
    draw, out = random.Random(seed), []
    for i in range(n):
        for turn in range(draw.randrange(12)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Agent"])
            text = draw.choice(["Yes.", "no", "", None, " \t", "Why?\n", "so ", "end. ", f"t{turn}!", f"x{draw.random()}."])
            out.append((i, draw.choice([turn, turn, turn, turn + 3, None]), role, text))
    return out


def test_given_table_against_brute_force(spark, tiny):
    table = spark.read.parquet(f"{tiny}/conversations.parquet")
    assert found(turn_repair.damaged_and_repaired(table)) == by_hand([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("segment", [turn_repair.SEGMENT, 3, 1])
def test_odd_rows(spark, segment, monkeypatch):
    """Nulls in every column, blank and repeated rows, shared turns; conversations within one segment and over many, several levels deep."""
    monkeypatch.setattr(turn_repair, "FAN", 2)
    rows = made(segment) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, None, None), (9_000, 0, "s" * 50, "long. " * 200_000), (9_000, 1, "u", "x.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.select("*", *[F.lit("x").alias(c) for c in ("conv", "at", "part", "said", "row", "fault", "edit", "nth", "copy", "kind")]).repartition(3)
    assert found(turn_repair.damaged_and_repaired(table, segment)) == by_hand(rows)


def test_search_against_all_edits():
    """Both directions agree with plain relaxation on every short row of codes, from every entry to every exit cost."""
    draw = random.Random(1)
    for _ in range(3000):
        letters = [(draw.choice("suao"), draw.choice([None, None, "blank", "truncated"])) for _ in range(draw.randrange(9))]
        codes = bytes(ord(i.upper() if m == "blank" else i) + (128 if m == "truncated" else 0) for i, m in letters)
        lattice = Lattice(codes)
        rows, marks = [(i, "x.") for i, _ in letters], [m for _, m in letters]
        assert lattice.least(0, turn_repair.ENDS)[:2] == cheapest(rows, marks)
        exits = [lattice.exits(entry) for entry in range(4)]
        after = [draw.choice([0, 1, 2, 5, 7, turn_repair.FAR]) for _ in range(4)]
        for entry in range(4):
            best = min(a + b for a, b in zip(exits[entry], after))
            got = lattice.least(entry, dict(enumerate(after)))
            assert (got is None and best >= turn_repair.FAR) or got[0] == best
            if got:
                assert lattice.follow(entry, got[1])[-1] == got[2]


def test_one_long_conversation(spark):
    """20,000 turns of one conversation: its segments are searched apart, and equal the whole."""
    draw = random.Random(4)
    rows = [(1, t, draw.choice(["user", "assistant"]), draw.choice([f"a{t}.", f"b{t}.", f"c{t}", "again.", ""])) for t in range(20_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert found(turn_repair.damaged_and_repaired(table)) == by_hand(rows)


def test_repaired_rows(spark):
    rows = [("c", 0, "assistant", "Hello."), ("c", 1, "user", "Hm"), ("c", 2, "user", "Well?"), ("d", 0, "system", "Be kind.")]
    table = spark.createDataFrame(rows, "k string, n int, who string, what string")
    repaired, summary = turn_repair.repair(table, "k", "n", "who", "what")
    lines = [(r.conv, r.role, r.text, r.edit) for r in repaired.orderBy("conv", "at", "nth").collect()]
    assert lines == [("c", "user", "Hello.", "R"), ("c", "assistant", "Well?", "R")]
    assert {(r.conv, r.cost, r.audit) for r in summary.collect()} == {("c", 4, "RDR"), ("d", 2, "D")}


def test_none(spark, tiny):
    empty = spark.read.parquet(f"{tiny}/conversations.parquet").limit(0)
    assert found(turn_repair.damaged_and_repaired(empty)) == []
    repaired, summary = turn_repair.repair(empty)
    assert repaired.collect() == [] and summary.collect() == []
