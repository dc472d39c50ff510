"""Per-key state of a stream in Spark's own state store: processors, and the reductions that run before the shuffle.

A processor sees one key at a time. So that a key with a third of all rows does not send them all to one task, every task first
reduces its own rows: to the newest few per key, or to one partial state per key. Both reductions may be applied again to their own output,
hold a bounded number of rows, and pass on what they hold when that is reached.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

HOLD = 100_000  # rows a task holds while it reduces
EVENT_TIME = "_event_time"

# Ship the processors with the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def reduced(reduce, hold: int = HOLD):
    """A function over a task's Arrow batches that applies ``reduce`` (table to table) to what it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= hold:
                table = reduce(pa.Table.from_batches(held))
                held, rows = table.to_batches(), table.num_rows
                if rows > hold // 2:  # many keys: holding on would not help
                    yield from held
                    held, rows = [], 0
        if held:
            yield from reduce(pa.Table.from_batches(held)).to_batches()

    return run


def newest(table: pa.Table, keys: Sequence[str], order: Sequence[str], size: int) -> pa.Table:
    """The ``size`` newest rows per key; nulls are oldest."""
    if not table.num_rows:
        return table
    by = [(k, "ascending") for k in keys] + [(o, "descending") for o in order]
    table = table.take(pc.sort_indices(table, sort_keys=by, null_placement="at_end"))
    first = np.zeros(table.num_rows, bool)
    first[0] = True
    for key in keys:
        codes = table[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first[1:] |= codes[1:] != codes[:-1]
    place = np.arange(table.num_rows)
    return table.filter(pa.array(place - np.maximum.accumulate(np.where(first, place, 0)) < size))


def _age(row: Sequence, places: Sequence[int]) -> tuple:
    return tuple((row[i] is not None, row[i]) for i in places)


class Newest(StatefulProcessor):
    """List state: the ``size`` newest rows of a key. With ``forget_after`` (milliseconds) a key without newer rows is dropped by a timer."""

    def __init__(self, columns: Sequence[str], schema: str, order: Sequence[str], size: int, forget_after: int | None) -> None:
        self.columns, self.schema, self.size, self.forget_after = list(columns), schema, size, forget_after
        self.places = [self.columns.index(c) for c in order]

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues):
        latest = self.seen.get()[0] if self.forget_after and self.seen.exists() else None
        times = []

        def values():
            for row in rows:
                if self.forget_after and row[EVENT_TIME] is not None:
                    times[:] = [max([*times, row[EVENT_TIME]])]
                yield tuple(row[c] for c in self.columns)

        kept = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        kept = heapq.nlargest(self.size, chain(kept, values()), key=lambda r: _age(r, self.places))
        self.rows.put(kept)
        if times and (latest is None or times[0] > latest):
            if latest is not None:
                self.handle.deleteTimer(latest + self.forget_after)
            self.handle.registerTimer(times[0] + self.forget_after)
            self.seen.update((times[0],))
        yield from (Row(**dict(zip(self.columns, r))) for r in kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.rows.clear()
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


#: Partial and stored state of a task: the newest change, when it last ended, the newest failure, and the number of changes.
TASK_FIELDS = ["at", "sequence", "status", "completed_at", "failed_at", "failed_sequence", "error", "changes"]
TASK_STATE = (
    "at long, sequence long, status string, completed_at long, failed_at long, failed_sequence long, error string, changes long"
)


def task_partials(table: pa.Table) -> pa.Table:
    """One partial state per task, from changes in the form of partial states (``changes`` 1) or from partial states."""

    def last(rows: pa.Table, order: list[str], values: list[str]) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(o, "ascending") for o in order], null_placement="at_start"))
        keep = pc.ScalarAggregateOptions(skip_nulls=False, min_count=0)
        found = rows.group_by("task_id", use_threads=False).aggregate([(c, "last", keep) for c in [*order, *values]])
        return found.rename_columns([c.removesuffix("_last") for c in found.column_names])

    sums = table.group_by("task_id", use_threads=False).aggregate([("completed_at", "max"), ("changes", "sum")])
    sums = {t: (c, n) for t, c, n in zip(*[sums[c].to_pylist() for c in ("task_id", "completed_at_max", "changes_sum")])}
    newest_change = last(table, ["at", "sequence"], ["status"])
    failures = last(table.filter(pc.is_valid(table["error"])), ["failed_at", "failed_sequence"], ["error"])
    failed = {t: v for t, *v in zip(*[failures[c].to_pylist() for c in ("task_id", "failed_at", "failed_sequence", "error")])}
    tasks = newest_change["task_id"].to_pylist()
    none = [None] * 3
    columns = {
        "task_id": newest_change["task_id"], "at": newest_change["at"], "sequence": newest_change["sequence"], "status": newest_change["status"],
        "completed_at": [sums[t][0] for t in tasks], "failed_at": [failed.get(t, none)[0] for t in tasks],
        "failed_sequence": [failed.get(t, none)[1] for t in tasks], "error": [failed.get(t, none)[2] for t in tasks], "changes": [sums[t][1] for t in tasks],
    }
    if EVENT_TIME in table.column_names:
        latest = table.group_by("task_id", use_threads=False).aggregate([(EVENT_TIME, "max")])
        latest = dict(zip(latest["task_id"].to_pylist(), latest[f"{EVENT_TIME}_max"].to_pylist()))
        columns[EVENT_TIME] = [latest[t] for t in tasks]
    return pa.table({f.name: pa.array(columns[f.name], f.type) if isinstance(columns[f.name], list) else columns[f.name] for f in table.schema}, schema=table.schema)


def merged(states: Sequence[Sequence]) -> tuple:
    """Partial states of one task -> its state."""
    newest_change = max(states, key=lambda s: _age(s, (0, 1)))
    ended = [s[3] for s in states if s[3] is not None]
    failures = [s for s in states if s[6] is not None]
    failed = max(failures, key=lambda s: _age(s, (4, 5)))[4:7] if failures else (None, None, None)
    return (*newest_change[:3], max(ended, default=None), *failed, sum(s[7] for s in states))


class LatestState(StatefulProcessor):
    """Value state: where a task stands. With ``forget_after`` (milliseconds) an ended task is dropped by a timer once nothing new comes."""

    ENDS = ("completed", "failed")

    def __init__(self, forget_after: int | None) -> None:
        self.forget_after = forget_after

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", TASK_STATE)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues):
        state = tuple(self.state.get()) if self.state.exists() else None
        times = []
        for row in rows:
            part = tuple(row[c] for c in TASK_FIELDS)
            state = merged([state, part]) if state else part
            if self.forget_after and row[EVENT_TIME] is not None:
                times = [max([*times, row[EVENT_TIME]])]
        self.state.update(state)
        if self.forget_after:
            self._schedule(state, times)
        yield Row(task_id=key[0], **dict(zip(TASK_FIELDS, state)))

    def _schedule(self, state: tuple, times: list[int]) -> None:
        due = self.due.get()[0] if self.due.exists() else None
        if state[2] not in self.ENDS:
            if due is not None:
                self.handle.deleteTimer(due)
                self.due.clear()
        elif times and (due is None or times[0] + self.forget_after > due):
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(times[0] + self.forget_after)
            self.due.update((times[0] + self.forget_after,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        self.due.clear()
        yield from ()

    def close(self) -> None:
        pass
