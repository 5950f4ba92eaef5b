"""Saves as streams: polled statuses, a burst of edits as one write, and writes one after the other.

A burst is debounced by a processing-time timer of its key's state: each edit moves the timer, and when it fires the last edit is written. Writes to one
key are serialised, since a key's rows lie in one task and are written in order; one that fails is told and stops none of those behind it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from furrow.sources import files

#: How long a burst waits for its next edit, and how often active tasks are polled. Fixed values.
DEBOUNCE_MS, POLL_S = 700, 5
ACTIVE = frozenset({"queued", "running"})
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Debounce(StatefulProcessor):
    """The last edit of a key and when it is due."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, body string, edits long")

    def _stop_timers(self) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seq, body, edits = self.last.get() if self.last.exists() else (None, None, 0)
        for batch in rows:
            edits += len(batch)
            for own, text in batch.sort_values("seq")[["seq", "body"]].itertuples(index=False):
                if seq is None or own >= seq:
                    seq, body = int(own), text
        self.last.update((seq, body, edits))
        self._stop_timers()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            seq, body, edits = self.last.get()
            self.last.clear()
            yield pd.DataFrame({"key": [key[0]], "seq": [seq], "body": [body], "edits": [edits]})

    def close(self) -> None:
        pass


def debounced(edits: DataFrame, wait_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(key, seq, body, edits) of a stream of edits (key string, seq long, body string): of each burst the edit with the highest `seq`, once no
    other has come for `wait_ms`, and how many there were. The state is one edit a key."""
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return edits.select("key", "seq", "body").groupBy("key").transformWithStateInPandas(_Debounce(wait_ms), "key string, seq long, body string, edits long", "append", "processingTime")


def serial_writes(rows: DataFrame, write: Callable[[str, str], None]) -> DataFrame:
    """(key, seq, error) of writes of (key, seq, body), one after the other for each key in the order of `seq`; error is null where it went well.

    Rows of a key lie in one partition, so no two of its writes are under way at once; a write that raises leaves its message and those behind it go on. A
    write may come again after a lost executor, so it must be a replacement.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for key, body in batch[["key", "body"]].itertuples(index=False):
                try:
                    write(key, body)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a write raises is told and must not stop the next
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "error": pd.Series(errors, dtype="object")})

    dealt = rows.select("key", "seq", "body").repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInPandas(run, "key string, seq long, error string")


def save_stream(edits: DataFrame, write: Callable[[str, str], None], told: str, checkpoint: str, wait_ms: int = DEBOUNCE_MS):
    """Start a query that writes each burst's last edit and appends what became of it to the table `told` (parquet)."""

    def batch(df: DataFrame, _: int) -> None:
        serial_writes(df, write).write.mode("append").parquet(told)

    return debounced(edits, wait_ms).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()


class StatusPoll(SimpleDataSourceStreamReader):
    """Each read is one poll of the statuses that are still active."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"poll": 0, "seen": {}}

    def _now(self) -> dict[str, str]:
        out = {}
        for path, _ in files.listed(self.path, ".json"):
            try:
                task = json.loads(files.ranges(path)(0, 1 << 20))
                out[str(task["task_id"])] = json.dumps([task.get("status"), int(task.get("progress") or 0)])
            except (OSError, ValueError, KeyError, TypeError):
                continue  # half written, or gone: the next poll sees it
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen, rows = dict(start["seen"]), []
        for task, state in sorted(self._now().items()):
            before = seen.get(task)
            active = before is None or json.loads(before)[0] in ACTIVE
            if active and before != state:
                status, progress = json.loads(state)
                rows.append((task, status, progress, start["poll"] + 1))
                seen[task] = state
        return iter(rows), {"poll": start["poll"] + 1, "seen": seen} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for task, state in sorted(end["seen"].items()):
            if start["seen"].get(task) != state:
                status, progress = json.loads(state)
                yield task, status, progress, end["poll"]


class StatusSource(DataSource):
    """(task_id, status, progress, poll): changes of task statuses, polled from a folder of JSON documents (task_id, status, progress).

    A task is polled until it has ended; documents that can't be read are polled again. The offset holds each task's last status, so a restarted query goes on
    where it stopped and tells nothing twice. The trigger's interval is the time between polls.
    """

    @classmethod
    def name(cls) -> str:
        return "task_status"

    def schema(self) -> str:
        return "task_id string, status string, progress int, poll long"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return StatusPoll(self.options)


def polled_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of status changes; start it with a processing-time trigger of POLL_S seconds."""
    spark.dataSource.register(StatusSource)
    return spark.readStream.format("task_status").load(folder)
