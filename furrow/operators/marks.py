"""Marks of a session with undo, replayed from a log.

Events are shuffled by session and sorted within partitions, so a task reads each session's events one after the other, in Arrow batches, and holds
one session's marks and at most 100 steps back; no session's log is ever a list.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import shuffle_width

#: Steps that can be undone. Fixed value.
MAX_HISTORY = 100


class Marks:
    """Marks by cell, and how to go back: each step keeps what it changed."""

    def __init__(self) -> None:
        self.marks: dict[str, str] = {}
        self.history: deque[tuple[str | None, object]] = deque(maxlen=MAX_HISTORY)

    def apply(self, action: str | None, cell: str | None, label: str | None) -> None:
        """mark (the same label again takes it away), unmark, clear or undo; what changes nothing leaves no step, nor does anything else."""
        if action == "undo":
            self.undo()
        elif action == "clear":
            if self.marks:
                self.history.append((None, self.marks))
                self.marks = {}
        elif cell is not None and (action == "unmark" and cell in self.marks or action == "mark" and label is not None):
            before = self.marks.get(cell)
            self.history.append((cell, before))
            if action == "unmark" or before == label:
                del self.marks[cell]
            else:
                self.marks[cell] = label

    def undo(self) -> None:
        if not self.history:
            return
        cell, before = self.history.pop()
        if cell is None:
            self.marks = before
        elif before is None:
            del self.marks[cell]
        else:
            self.marks[cell] = before


def replay(events: DataFrame, session: str, seq: str, every: bool = False) -> DataFrame:
    """(session, cell, label): what is marked at the end of each session's log of (action, cell, label) in the order of `seq`.

    With `every` a row an event instead: (session, seq, marked, steps), how many cells are marked then and how many steps can be undone.
    Events of a null session are a session; events of equal `seq` are ordered by action, cell and label.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (session, seq)}
    names, schema = ([session, seq, "marked", "steps"], f"`{session}` {kinds[session]}, `{seq}` {kinds[seq]}, marked long, steps long") if every else ([session, "cell", "label"], f"`{session}` {kinds[session]}, cell string, label string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = here = None
        state, begun = Marks(), False

        def final() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([here] * len(state.marks), kind), pa.array(list(state.marks)), pa.array(list(state.marks.values()))], names=names)

        for batch in batches:
            kind = batch.column(0).type
            told = []
            for own, at, action, cell, label in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or own != here:
                    if begun and state.marks and not every:
                        yield final()
                    here, state, begun = own, Marks(), True
                state.apply(action, cell, label)
                if every:
                    told.append((own, at, len(state.marks), len(state.history)))
            if told:
                kinds_ = [batch.column(0).type, batch.column(1).type, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told, strict=True), kinds_, strict=True)], names=names)
        if begun and state.marks and not every:
            yield final()

    log = events.select(session, seq, "action", F.col("cell").cast("string"), F.col("label").cast("string"))
    dealt = log.repartition(shuffle_width(events.sparkSession, log), session).sortWithinPartitions(session, seq, "action", "cell", "label")
    return dealt.mapInArrow(run, schema)
