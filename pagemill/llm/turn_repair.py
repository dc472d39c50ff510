"""Conversations with broken structure, repaired at least cost.

A conversation's rows and the role pattern ``(s?(ua)+)?`` span a lattice: a node is (rows consumed, state of the pattern), an
edge an edit. A bidirectional Dijkstra finds the cheapest edits: a forward heap grows from the entry, a reverse heap from the
exits, they meet, all crossings of equal cost are finished, and the least concatenated audit wins.

Rows of one conversation are cut into segments of at most ``SEGMENT`` rows, so a conversation of any length spreads over many tasks.
A segment's part in the whole is a 4 x 4 table of costs (state at entry, state at exit). Tables of ``FAN`` neighbours are
multiplied (minimum, plus) level by level, and exit costs then go down the same levels; with them a segment's search knows what each exit
still costs. The least audit chooses, at every node, the least letter on a cheapest path, so segments that know their entry choose alike.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagemill.plans.ordered import join_null_safe, row_index
from pagemill.plans.stored import materialize

SEGMENT = 512  # rows of a segment
FAN = 256  # tables multiplied in one task per level
FAR = 1 << 60

#: States of the pattern: nothing yet, after s, after u, after a. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {START: 0, ASSISTANT: 0}
#: (state, initial) -> state
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: state -> the spoken role that may come next
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5

#: A row as one byte: role initial s, u, a or another (o); upper case: must go (blank or duplicate); with this bit: truncated.
TRUNCATED_BIT = 0x80


class Lattice:
    """Edit lattice over the row codes of one segment."""

    def __init__(self, codes: bytes) -> None:
        self.size = len(codes)
        self.rows = []
        for code in codes:
            letter = chr(code & ~TRUNCATED_BIT)
            self.rows.append((letter.lower(), letter.isupper(), TRUNCATED_COST if code & TRUNCATED_BIT else 0))
        self.into: dict[int, list[int]] = {}
        for state, role in NEXT.items():
            self.into.setdefault(MOVES[state, role], []).append(state)

    def ahead(self, node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
        """(cost, letter, next node) of the edits possible at a node."""
        at, state = node
        spoken = MOVES[state, NEXT[state]]
        yield COSTS[INSERT], INSERT, (at, spoken)
        if at < self.size:
            initial, gone, extra = self.rows[at]
            yield COSTS[DELETE], DELETE, (at + 1, state)
            if not gone:
                if (state, initial) in MOVES:
                    yield COSTS[KEEP] + extra, KEEP, (at + 1, MOVES[state, initial])
                yield COSTS[REROLE] + extra, REROLE, (at + 1, spoken)

    def behind(self, node: tuple[int, int]) -> Iterator[tuple[int, str, tuple[int, int]]]:
        """(cost, letter, earlier node) of the edits that lead to a node."""
        at, state = node
        for earlier in self.into.get(state, ()):
            yield COSTS[INSERT], INSERT, (at, earlier)
        if at:
            initial, gone, extra = self.rows[at - 1]
            yield COSTS[DELETE], DELETE, (at - 1, state)
            if not gone:
                for earlier in range(4):
                    if MOVES.get((earlier, initial)) == state:
                        yield COSTS[KEEP] + extra, KEEP, (at - 1, earlier)
                for earlier in self.into.get(state, ()):
                    yield COSTS[REROLE] + extra, REROLE, (at - 1, earlier)

    def exits(self, entry: int) -> list[int]:
        """Least cost from a state at entry to each state at exit, without audits."""
        settled: set[tuple[int, int]] = set()
        heap, out = [(0, (0, entry))], [FAR] * 4
        while heap:
            cost, node = heapq.heappop(heap)
            if node in settled:
                continue
            settled.add(node)
            if node[0] == self.size:
                out[node[1]] = cost
            for step, _, other in self.ahead(node):
                if other not in settled:
                    heapq.heappush(heap, (cost + step, other))
        return out

    def least(self, entry: int, exits: dict[int, int]) -> tuple[int, str, int] | None:
        """Cheapest edits from ``entry`` to any exit, where ``exits`` holds what each still costs: (cost, least audit, exit).

        Labels are (cost, audit). Equal costs settle in the order of rows (only keeping is free, and it consumes a row), so a
        label is final when its node is taken from the heap. Behind all exits stands a goal that is settled from the start. Both searches
        stop once their least keys together exceed the best crossing: every node of a cheapest path is then settled by one of them, so each such
        path holds a node settled by both, or an edge from one settled ahead to one settled behind.
        """
        base = min(exits.values(), default=FAR)
        if base >= FAR:
            return None
        exits = {state: cost - base for state, cost in exits.items() if cost < FAR}
        ahead: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
        behind = {(self.size, state): (cost, "") for state, cost in exits.items()}
        forward, reverse = [(0, 0, (0, entry))], [(cost, -self.size, node) for node, (cost, _) in behind.items()]
        heapq.heapify(reverse)
        settled_ahead, settled_behind = set(), set()
        best = FAR
        while forward and reverse:
            if forward[0][0] + reverse[0][0] > best:
                break
            if forward[0][0] <= reverse[0][0]:
                cost, _, node = heapq.heappop(forward)
                if node in settled_ahead:
                    continue
                settled_ahead.add(node)
                audit = ahead[node][1]
                if node in behind:
                    best = min(best, cost + behind[node][0])
                for step, letter, other in self.ahead(node):
                    label = (cost + step, audit + letter)
                    if other not in settled_ahead and label < ahead.get(other, (FAR, "")):
                        if label[0] < ahead.get(other, (FAR, ""))[0]:
                            heapq.heappush(forward, (label[0], other[0], other))
                        ahead[other] = label
            else:
                cost, _, node = heapq.heappop(reverse)
                if node in settled_behind:
                    continue
                settled_behind.add(node)
                audit = behind[node][1]
                if node in ahead:
                    best = min(best, cost + ahead[node][0])
                for step, letter, other in self.behind(node):
                    label = (cost + step, letter + audit)
                    if other not in settled_behind and label < behind.get(other, (FAR, "")):
                        if label[0] < behind.get(other, (FAR, ""))[0]:
                            heapq.heappush(reverse, (label[0], -other[0], other))
                        behind[other] = label
        if best >= FAR:
            return None
        crossings = []
        for node in settled_ahead:
            cost, audit = ahead[node]
            if node[0] == self.size and cost + exits.get(node[1], FAR) == best:
                crossings.append(audit)
            if node in settled_behind and cost + behind[node][0] == best:
                crossings.append(audit + behind[node][1])
            for step, letter, other in self.ahead(node):
                if other in settled_behind and cost + step + behind[other][0] == best:
                    crossings.append(audit + letter + behind[other][1])
        audit = min(crossings)
        return best + base, audit, self.follow(entry, audit)[-1]

    def follow(self, entry: int, audit: str) -> list[int]:
        """States after each letter; an audit decides every role."""
        states, at = [entry], 0
        for letter in audit:
            state = states[-1]
            if letter in (INSERT, REROLE):
                state = MOVES[state, NEXT[state]]
            elif letter == KEEP:
                state = MOVES[state, self.rows[at][0]]
            at += letter != INSERT
            states.append(state)
        return states


def multiply(left: list[int], right: list[int]) -> list[int]:
    """Cost table of two neighbours (16 numbers, entry before exit)."""
    return [min(min(left[4 * i + k] + right[4 * k + j] for k in range(4)), FAR) for i in range(4) for j in range(4)]


def exit_costs(table: list[int], after: list[int]) -> list[int]:
    """What each entry state still costs, given what each exit state does."""
    return [min(min(table[4 * i + k] + after[k] for k in range(4)), FAR) for i in range(4)]


def _as_string(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows broken by crc32(``conv:turn``) modulo 20: 0 drops, 1 empties the text, 2 removes its ``.!?``, 3 repeats, 4 makes it a user's.

    Nulls count as one space. Columns: ``conv``, ``turn`` as they are, ``role``, ``text`` without nulls. Map-only.
    """
    kind = F.crc32(F.concat(_as_string(F.col(conv)), F.lit(":"), _as_string(F.col(turn))).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), kind.alias("kind"), _as_string(F.col(role)).alias("role"), _as_string(F.col(text)).alias("text")
    ).filter("kind <> 0")
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    broken = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", broken)
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _stored(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows as they go through the repair, written once: ``row`` names them, ``said`` stands for role and text, ``text`` is needed only at the end."""
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), _as_string(F.col(role)).alias("role"), _as_string(F.col(text)).alias("text"))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    # The text's last character that is no white space; trimming is native, a pattern would try every place of the text.
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    named = plain.select("*", F.unhex(F.left(said, F.lit(32))).alias("said"), fault.alias("own_fault"), initial.alias("initial"))
    return materialize(named.withColumn("row", F.monotonically_increasing_id()), "rows")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows without text: ``at``, their place in the conversation, ``initial`` and ``fault``; stored."""
    narrow = rows.select("conv", "turn", "said", "row", "own_fault", "initial")
    # Equal rows may be any number; the last part of the order lets them spread.
    order = [F.col("turn").asc_nulls_first(), F.col("said").asc(), F.col("row").asc()]
    placed = materialize(row_index(narrow, order, ["conv"], "at"), "places")
    # What is said once is no duplicate; only what is said again needs to find its first place.
    again = placed.groupBy("conv", "said").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = join_null_safe(placed.select("conv", "said", "at"), again.drop("n"), ["conv", "said"]).filter("at > first")
    marked = join_null_safe(placed.drop("said"), late.select("conv", "at", F.lit(True).alias("late")), ["conv", "at"], "left")
    fault = F.when(F.col("late") & ~F.col("own_fault").eqNullSafe("blank"), "duplicate").otherwise(F.col("own_fault"))
    return materialize(marked.select("conv", "turn", "at", "row", "initial", fault.alias("fault")), "faults")


def _code() -> Column:
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.upper("initial")).otherwise(F.col("initial"))
    return (F.ascii(letter) + F.when(F.col("fault") == "truncated", TRUNCATED_BIT).otherwise(0)).cast("int")


def _segments(turns: DataFrame, segment: int) -> DataFrame:
    """One row per segment: ``codes`` of its rows in order, and how many neighbours, the last row before it included, break the pattern."""
    own = F.floor(F.col("at") / segment).cast("long")
    ends = F.col("at") % segment == segment - 1
    rows = turns.select("conv", "at", _code().alias("code"), own.alias("own"), F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))).alias("part"))
    mine = F.when(F.col("own") == F.col("part"), F.struct("at", "code"))
    lead = F.max(F.when(F.col("own") < F.col("part"), F.col("code")))
    parts = rows.groupBy("conv", "part").agg(F.array_sort(F.collect_list(mine))["code"].alias("codes"), lead.alias("lead"))
    return parts.filter(F.size("codes") > 0)


def _illegal(lead: int | None, codes: list[int]) -> int:
    initials = [chr(c & ~TRUNCATED_BIT).lower() for c in ([] if lead is None else [lead]) + codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _tables(batches):
    """Segments -> their cost tables."""
    for batch in batches:
        tables = []
        for codes in batch.column("codes").to_pylist():
            lattice = Lattice(bytes(codes))
            tables.append([cost for entry in range(4) for cost in lattice.exits(entry)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(tables, pa.list_(pa.int64()))], names=["conv", "part", "table"])


def _products(batches):
    for batch in batches:
        out = []
        for tables in batch.column("tables").to_pylist():
            total = tables[0]
            for table in tables[1:]:
                total = multiply(total, table)
            out.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(out, pa.list_(pa.int64()))], names=["conv", "part", "table"])


def _afters(batches):
    """Blocks with the exit costs after them -> the exit costs after each of their members."""
    for batch in batches:
        convs, parts, afters = [], [], []
        for conv, members, after in zip(batch.column("conv").to_pylist(), batch.column("members").to_pylist(), batch.column("after").to_pylist()):
            for member in reversed(members):
                convs.append(conv)
                parts.append(member["part"])
                afters.append(after)
                after = exit_costs(member["table"], after)
        yield pa.RecordBatch.from_arrays(
            [pa.array(convs, batch.column("conv").type), pa.array(parts, pa.int64()), pa.array(afters, pa.list_(pa.int64()))], names=["conv", "part", "after"]
        )


def _choices(batches):
    """Segments with the exit costs after them -> per entry state the least audit's exit (or -1)."""
    for batch in batches:
        out = []
        for codes, after in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist()):
            lattice = Lattice(bytes(codes))
            found = [lattice.least(entry, dict(enumerate(after))) for entry in range(4)]
            out.append([f[2] if f else -1 for f in found])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(out, pa.list_(pa.int32()))], names=["conv", "part", "jump"])


def _chained(batches):
    for batch in batches:
        out = []
        for jumps in batch.column("jumps").to_pylist():
            total = jumps[0]
            for jump in jumps[1:]:
                total = [jump[state] if state >= 0 else -1 for state in total]
            out.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), pa.array(out, pa.list_(pa.int32()))], names=["conv", "part", "jump"])


def _entries(batches):
    for batch in batches:
        convs, parts, entries = [], [], []
        for conv, members, entry in zip(batch.column("conv").to_pylist(), batch.column("members").to_pylist(), batch.column("entry").to_pylist()):
            for member in members:
                convs.append(conv)
                parts.append(member["part"])
                entries.append(entry)
                entry = member["jump"][entry]
        yield pa.RecordBatch.from_arrays(
            [pa.array(convs, batch.column("conv").type), pa.array(parts, pa.int64()), pa.array(entries, pa.int32())], names=["conv", "part", "entry"]
        )


def _audits(batches):
    """Segments with entry and exit costs -> cost of their own edits, audit, and per row what it becomes."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("before", pa.list_(pa.string()))]))
    for batch in batches:
        costs, audits, breaks, steps, tails = [], [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("codes", "lead", "entry", "after", "start")]
        for codes, lead, entry, after, start in zip(*columns):
            lattice = Lattice(bytes(codes))
            cost, audit, leave = lattice.least(entry, dict(enumerate(after)))
            costs.append(cost - after[leave])
            audits.append(audit)
            breaks.append(_illegal(lead, codes))
            states, at, before, done = lattice.follow(entry, audit), start, [], []
            for letter, state in zip(audit, states):
                spoken = ROLES[NEXT[state]]
                if letter == INSERT:
                    before.append(spoken)
                else:
                    done.append({"at": at, "edit": letter, "role": spoken if letter == REROLE else None, "before": before})
                    at, before = at + 1, []
            steps.append(done)
            tails.append(before)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv"), batch.column("part"), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(breaks, pa.int64()),
                pa.array(steps, kind), pa.array(tails, pa.list_(pa.string())),
            ],
            names=["conv", "part", "cost", "audit", "illegal", "steps", "tail"],
        )


def _blocks(members: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Neighbours of a level gathered into blocks of at most ``FAN``."""
    block = F.floor(F.col("part") / FAN).cast("long")
    return members.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("part", *columns))).alias(name))


def _levels(leaves: DataFrame, column: str, many: str, combine, kind: str) -> list[DataFrame]:
    """``leaves`` and the products of their blocks, level by level, until every conversation has one part."""
    levels = [leaves]
    while levels[-1].agg(F.max("part")).first()[0]:
        blocks = _blocks(levels[-1], [column], "members")
        blocks = blocks.select("conv", F.col("block").alias("part"), F.col(f"members.{column}").alias(many))
        levels.append(materialize(blocks.mapInArrow(combine, f"conv {kind}, part long, {column} array<{'long' if column == 'table' else 'int'}>"), column))
    return levels


def _solved(turns: DataFrame, segment: int) -> DataFrame:
    """One row per segment: ``cost``, ``audit``, ``illegal``, ``steps``, ``tail``."""
    kind = turns.schema["conv"].dataType.simpleString()
    segments = materialize(_segments(turns, segment), "segments")
    last = F.array(*[F.lit(ENDS.get(state, FAR)).cast("long") for state in range(4)])
    # Conversations of one segment need no tables: they start at START and end at the ends.
    several = segments.filter("part > 0").select("conv").distinct()
    several = join_null_safe(segments, several.withColumn("_long", F.lit(True)), ["conv"], "left").withColumn("_long", F.coalesce("_long", F.lit(False)))
    several = materialize(several, "several")
    long_ones = several.filter("_long")
    tables = materialize(long_ones.select("conv", "part", "codes").mapInArrow(_tables, f"conv {kind}, part long, table array<long>"), "tables")
    levels = _levels(tables, "table", "tables", _products, kind)
    after = levels[-1].select("conv", "part", last.alias("after"))
    for members in reversed(levels[:-1]):
        blocks = _blocks(members, ["table"], "members").withColumnRenamed("block", "part")
        blocks = join_null_safe(blocks, after, ["conv", "part"])
        after = materialize(blocks.select("conv", "members", "after").mapInArrow(_afters, f"conv {kind}, part long, after array<long>"), "after")
    known = materialize(join_null_safe(long_ones.drop("_long"), after, ["conv", "part"]), "known")
    jumps = materialize(known.select("conv", "part", "codes", "after").mapInArrow(_choices, f"conv {kind}, part long, jump array<int>"), "jumps")
    levels = _levels(jumps, "jump", "jumps", _chained, kind)
    entry = levels[-1].select("conv", "part", F.lit(START).alias("entry"))
    for members in reversed(levels[:-1]):
        blocks = join_null_safe(_blocks(members, ["jump"], "members").withColumnRenamed("block", "part"), entry, ["conv", "part"])
        entry = materialize(blocks.select("conv", "members", "entry").mapInArrow(_entries, f"conv {kind}, part long, entry int"), "entry")
    names = ["conv", "part", "codes", "lead", "entry", "after"]
    short = several.filter("NOT _long").select("conv", "part", "codes", "lead", F.lit(START).alias("entry"), last.alias("after"))
    ready = join_null_safe(known, entry, ["conv", "part"]).select(names).union(short).withColumn("start", F.col("part") * segment)
    steps = "array<struct<at: long, edit: string, role: string, before: array<string>>>"
    schema = f"conv {kind}, part long, cost long, audit string, illegal long, steps {steps}, tail array<string>"
    return materialize(ready.mapInArrow(_audits, schema), "audits")


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """(repaired rows, one row per conversation).

    Repaired rows: ``conv``, ``at`` (place of the row they come from or stand before; one past the last for those at the end),
    ``nth`` (order among the rows of one place), ``role``, ``text``, ``edit`` (``I``, ``K`` or ``R``). Conversations: ``conv``, ``gaps``,
    ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.

    Rows stand by turn (nulls first), rows of one turn by a hash of role and text, so that equal rows are neighbours. Nulls in role and
    text count as one space; a null conversation is a conversation like any other. Roles count by their first character; empty and
    other ones fit nowhere and are renamed or deleted. Texts of any length stay whole; they are stored once and travel once, to the
    verdict on their row. Further columns are dropped, whatever their names. An empty table gives two empty ones. No task holds more than a segment of a conversation,
    except for the one audit string that the result asks for.
    """
    stored = _stored(rows, conv, turn, role, text)
    turns = _ordered(stored)
    solved = _solved(turns, segment)
    counts = turns.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    counts = counts.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    audits = solved.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("part", "audit")))["audit"], "").alias("audit")
    )
    steps = solved.select("conv", F.explode("steps").alias("s")).select("conv", "s.at", F.col("s.edit").alias("edit"), F.col("s.role").alias("new_role"), "s.before")
    steps = join_null_safe(turns.select("conv", "at", "row"), steps, ["conv", "at"])
    done = steps.join(stored.select("row", "role", "text"), "row")
    made = F.transform("before", lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit(INSERT).alias("edit")))
    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text"), F.col("edit").alias("edit")))
    own = F.filter(own, lambda x: x["edit"] != DELETE)
    repaired = done.select("conv", "at", F.posexplode(F.concat(made, own)).alias("nth", "x")).select("conv", "at", "nth", "x.*")
    ends = solved.filter(F.size("tail") > 0).select("conv", (F.col("part") * segment + F.size("steps")).alias("at"), F.posexplode("tail").alias("nth", "role"))
    # A place's inserted rows come before its own; a tail stands before the next segment's first row, whose rows get later numbers.
    repaired = repaired.withColumn("nth", F.col("nth") + LATE).union(ends.select("conv", "at", "nth", "role", F.lit("").alias("text"), F.lit(INSERT).alias("edit")))
    return repaired, join_null_safe(counts, audits, ["conv"])


LATE = 1 << 20


def _digests(batches):
    """Rows sorted by conversation and place -> SHA-256 of each conversation's ``role:text`` lines. Holds one hash, no rows."""
    open_one, hashed = None, None
    for batch in batches:
        convs, digests = [], []
        columns = [batch.column(c).to_pylist() for c in ("conv", "role", "text")]
        for conv, role, text in zip(*columns):
            if hashed is None or conv != open_one:
                if hashed is not None:
                    convs.append(open_one)
                    digests.append(hashed.hexdigest())
                open_one, hashed = conv, hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{text}".encode())
        kind = batch.column("conv").type
        yield pa.RecordBatch.from_arrays([pa.array(convs, kind), pa.array(digests, pa.string())], names=["conv", "sha"])
    if hashed is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_one], kind), pa.array([hashed.hexdigest()], pa.string())], names=["conv", "sha"])


def digests(repaired: DataFrame) -> DataFrame:
    """(``conv``, ``sha``) of the repaired rows joined by newlines. A hash reads its conversation in order, so one task streams each."""
    kind = repaired.schema["conv"].dataType.simpleString()
    ordered = repaired.repartition("conv").sortWithinPartitions("conv", "at", "nth").select("conv", "role", "text")
    return ordered.mapInArrow(_digests, f"conv {kind}, sha string")


def damaged_and_repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per original ``conv_id`` of a table that is damaged first: its faults, least cost, audit, and digest after repair.

    A conversation without rows after damage has zeros, an empty audit and the digest of the empty string. Otherwise as ``repair``.
    """
    repaired, found = repair(damage(conversations), "conv", "turn", "role", "text", segment)
    rows = conversations.select(F.col("conv_id").alias("conv")).distinct()
    rows = join_null_safe(join_null_safe(rows, found, ["conv"], "left"), digests(repaired), ["conv"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return rows.select(F.col("conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), sha)
