"""Leases, resumable bakes and uploads as keyed streams: a key's state belongs to one task at a time, so a claim is atomic."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from furrow.streaming.pipeline import LEASE_S, MAX_ATTEMPTS, advance_cursor, claim


def _lease(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"task_id": [key[0]], "worker": [None], "at": [None], "granted": [False]})
        return
    holder, since = state.get if state.exists else (None, None)
    out = []
    for rows in batches:
        for worker, at in rows.sort_values(["at", "worker"])[["worker", "at"]].itertuples(index=False):
            holder, since, mine = claim(holder, since, worker, float(at))
            out.append((key[0], worker, float(at), mine))
    state.update((holder, since))
    state.setTimeoutDuration(LEASE_S * 1000)
    yield pd.DataFrame(out, columns=["task_id", "worker", "at", "granted"])


def leases(claims: DataFrame) -> DataFrame:
    """(task_id, worker, at, granted) for each claim (task_id long, worker string, at double, in seconds). A lease that isn't claimed for its whole
    length falls to nobody, and a row without a worker says so."""
    kind = "task_id long, worker string, at double, granted boolean"
    return claims.groupBy("task_id").applyInPandasWithState(_lease, kind, "holder string, since double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _bake(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cursor, stalls, done = state.get if state.exists else (0, 0, False)
    for rows in batches:
        for total, size, failed in rows.sort_values("call")[["total", "size", "failed"]].itertuples(index=False):
            if not done:
                cursor, stalls, done = advance_cursor(cursor, int(total), int(size), [int(f) for f in (failed if failed is not None else [])], stalls)
    state.update((int(cursor), int(stalls), bool(done)))
    yield pd.DataFrame({"bake_id": [key[0]], "cursor": [int(cursor)], "stalls": [int(stalls)], "done": [bool(done)]})


def bake_cursors(calls: DataFrame) -> DataFrame:
    """(bake_id, cursor, stalls, done) after each micro-batch of (bake_id long, call int, total int, size int, failed array<int>): the cursor waits at the
    first failure, and done needs the end and no failure."""
    kind = "bake_id long, cursor int, stalls int, done boolean"
    return calls.groupBy("bake_id").applyInPandasWithState(_bake, kind, "cursor int, stalls int, done boolean", "update", GroupStateTimeout.NoTimeout)


def uploads_left(files: DataFrame, attempts: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Files (key, ..) that are still to be sent, with `tried`: neither sent nor failed `most` times, from attempts (key, ok)."""
    seen = attempts.groupBy("key").agg(F.max("ok").alias("__ok"), F.count_if(~F.col("ok")).alias("tried"))
    left = files.join(seen, "key", "left").withColumn("tried", F.coalesce("tried", F.lit(0)))
    return left.filter(~F.coalesce("__ok", F.lit(False)) & (F.col("tried") < most)).drop("__ok")


#: How long a stored upload checkpoint is good for, in hours. Fixed value.
CHECKPOINT_HOURS = 24


def checkpoint_uploads(stored: DataFrame, batch: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """The stored checkpoints (batch, saved_at, done) with those of the batches in `batch` (batch, key) renewed: the keys that attempts (key, ok) have sent.

    What a checkpoint held before stays done; a batch whose files are all done needs none and goes.
    """
    sent = attempts.filter("ok").select("key").distinct()
    before = stored.select("batch", F.explode("done").alias("key"))
    done = batch.join(sent, "key", "left_semi").select("batch", "key").unionByName(before.join(batch.select("batch").distinct(), "batch", "left_semi")).distinct()
    renewed = done.groupBy("batch").agg(F.collect_set("key").alias("done")).select("batch", now.alias("saved_at"), "done")
    sizes = batch.groupBy("batch").agg(F.count_distinct("key").alias("n"))
    open_ = renewed.join(sizes, "batch").filter(F.size("done") < F.col("n")).drop("n")
    return stored.join(sizes, "batch", "left_anti").select("batch", "saved_at", "done").unionByName(open_)


def resume_uploads(files: DataFrame, stored: DataFrame, now: Column, hours: int = CHECKPOINT_HOURS) -> DataFrame:
    """The files (batch, key, ..) that are still to be sent by the stored checkpoints (batch, saved_at, done); one that is older counts for nothing."""
    fresh = stored.filter(now - F.col("saved_at") <= F.make_dt_interval(hours=F.lit(hours))).select("batch", F.explode("done").alias("key"))
    return files.join(fresh, ["batch", "key"], "left_anti")
