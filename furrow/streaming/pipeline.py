"""The scan pipeline's state: statuses, leases, retry budgets and resumable cursors.

Pure transitions, used by a keyed stateful stream and by batch replays alike. Plain files have no compare-and-set, so
leases assume one writer: the stream's own state store, which gives a key to one task at a time.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Status codes of the processing node, lease length, retries, statuses worth another try. Fixed values.
STATUS = {10: "queued", 20: "running", 30: "failed", 40: "completed", 50: "canceled"}
LEASE_S, MAX_ATTEMPTS = 15 * 60, 4
RETRYABLE = frozenset({408, 425, 429, 500, 502, 503, 504})


def next_status(now: str | None, code: int | None) -> str:
    """A terminal status stays; unknown codes change nothing."""
    if now in ("completed", "canceled"):
        return now
    return STATUS.get(code or 0, now or "queued")


def claim(holder: str | None, since: float | None, me: str, now: float) -> tuple[str | None, float | None, bool]:
    """(holder, since, mine): a lease is free if nobody holds it, it has no start, or it is stale."""
    if holder is None or since is None or now - since > LEASE_S:
        return me, now, True
    return holder, since, holder == me


def after_attempt(attempts: int, ok: bool) -> tuple[int, str]:
    """Attempts so far and what follows: done resets, four failures end it."""
    if ok:
        return 0, "done"
    attempts += 1
    return attempts, "failed" if attempts >= MAX_ATTEMPTS else "retry"


def advance_cursor(cursor: int, total: int, batch: int, failed: list[int], stalls: int) -> tuple[int, int, bool]:
    """(cursor, stalls, done) after a batch: held at the first failure; after three stalls one item is skipped."""
    end = min(total, cursor + batch)
    to = min([f for f in failed if cursor <= f < end], default=end)
    if to == cursor and failed:
        stalls += 1
        if stalls >= 3:
            to, stalls = cursor + 1, 0
    else:
        stalls = 0
    return to, stalls, to >= total and not failed


def with_retry(call: Callable[[], int], attempts: int = MAX_ATTEMPTS, base_s: float = 0.8, sleep: Callable[[float], None] = time.sleep) -> int:
    """Repeat a call that returns a status while that is worth another try, with jittered doubling waits."""
    for i in range(attempts):
        status = call()
        if status not in RETRYABLE or i == attempts - 1:
            return status
        sleep(base_s * 2**i * (0.5 + random.random() / 2))
    return status


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, attempts = state.get if state.exists else (None, 0)
    for rows in batches:
        for code in rows.sort_values(["ts", "code"])["code"].tolist():
            status = next_status(status, int(code))
            if status == "failed":
                attempts, what = after_attempt(attempts, False)
                status = "failed" if what == "failed" else "queued"
            elif status == "completed":
                attempts = 0
    state.update((status or "queued", attempts))
    yield pd.DataFrame({"scan_id": [key[0]], "status": [status or "queued"], "attempts": [attempts]})


def scan_status(events: DataFrame) -> DataFrame:
    """(scan_id, status, attempts) after each micro-batch of (scan_id long, code int, ts timestamp)."""
    return events.groupBy("scan_id").applyInPandasWithState(_step, "scan_id long, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)
