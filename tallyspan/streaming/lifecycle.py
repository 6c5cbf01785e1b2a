"""Streams: micro-batch rounds over snapshots, and keyed state for schedule claims and leases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def claim_stream(attempts: DataFrame) -> DataFrame:
    """High-water claims of a stream (schedule_id, ord, occurrence): state is the mark of each schedule."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("ord")  # one schedule's attempts of one micro-batch
        out = []
        for r in rows.itertuples():
            claimed = mark is None or r.occurrence > mark
            mark = r.occurrence if claimed else mark
            out.append((key[0], r.ord, r.occurrence, claimed))
        state.update((mark,))
        yield pd.DataFrame(out, columns=["schedule_id", "ord", "occurrence", "claimed"])

    return attempts.groupBy("schedule_id").applyInPandasWithState(step, "schedule_id string, ord long, occurrence long, claimed boolean", "mark long", "append", GroupStateTimeout.NoTimeout)


def lease_stream(events: DataFrame, keep_ms: int = 86_400_000) -> DataFrame:
    """Leases by a clock column: rows (id, ord, op, t, lease) with op reserve, extend or ack to (id, ord, outcome).

    A reserve is granted if no lease runs at ``t``; a second grant is a redelivery. Extend and ack are stale after the end.
    An id that was acked is forgotten ``keep_ms`` later, so the state holds running jobs and what was done lately.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until, given, done = state.get if state.exists else (None, 0, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("ord").itertuples():
            runs = until is not None and r.t < until
            if r.op == "reserve":
                what = "gone" if done else "held" if runs else "redelivered" if given else "reserved"
                if what in ("reserved", "redelivered"):
                    until, given = r.t + r.lease, given + 1
            elif not runs or done:
                what = "stale"
            elif r.op == "extend":
                what, until = "extended", r.t + r.lease
            else:
                what, done, until = "acked", True, None
            out.append((key[0], r.ord, what))
        state.update((until, given, done))
        if done:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame(out, columns=["id", "ord", "outcome"])

    return events.groupBy("id").applyInPandasWithState(step, "id string, ord long, outcome string", "until long, given long, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_rounds(stream: DataFrame, round_: Callable[[DataFrame, int], Any], checkpoint: str, **trigger: Any):
    """Start a query whose micro-batches each go through ``round_(batch, number)``, which writes the next snapshots."""
    return stream.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
