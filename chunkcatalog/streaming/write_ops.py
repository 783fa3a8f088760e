"""Write operations as a stream: idempotent, with expiry; and maintenance by ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "idempotency_key string, event string, at timestamp"
_OUT = "idempotency_key string, state string, at timestamp"
_STATE = "state string, last_ms bigint"


def lifecycle(events: DataFrame, expiry_s: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """State changes ``(idempotency_key, state, at)`` of ``events(idempotency_key, event, at)``.

    ``open`` prepares an operation, ``touch`` keeps it alive, ``commit`` and ``abandon`` end it. One that is silent for ``expiry_s`` seconds of event
    time is abandoned. An ended operation never changes again, so replays of a key do nothing.
    """
    ends = {"commit": "committed", "abandon": "abandoned"}

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, last = state.get if state.exists else ("", 0)
        changes = []
        if state.hasTimedOut:
            if now == "prepared":
                changes.append((key[0], "abandoned", pd.Timestamp(last + expiry_s * 1000, unit="ms")))
                now = "abandoned"
            state.update((now, last))
        else:
            for row in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
                if now in ends.values():
                    continue
                last = max(last, int(row.at.timestamp() * 1000))
                after = ends.get(row.event, "prepared" if row.event == "open" or now else "")
                if after and after != now:
                    changes.append((key[0], after, row.at))
                    now = after
            state.update((now, last))
            if now == "prepared":
                state.setTimeoutTimestamp(max(last + expiry_s * 1000, state.getCurrentWatermarkMs() + 1))
        if changes:
            yield pd.DataFrame(changes, columns=["idempotency_key", "state", "at"])

    return events.withWatermark("at", delay).groupBy("idempotency_key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def once(events: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first event of each key, as replays within the watermark's delay are dropped."""
    return events.withWatermark("at", within).dropDuplicatesWithinWatermark(["idempotency_key"])


def ticks(stream: DataFrame, run: Callable[[DataFrame, int], None], every: str = "1 second") -> DataStreamWriter:
    """Runs maintenance for each micro-batch; a batch that is replayed has the same number."""
    return stream.writeStream.foreachBatch(run).trigger(processingTime=every)


def cooled_down(last_moved_ns: int | None, now_ns: int, cooldown_ns: int) -> bool:
    return last_moved_ns is None or now_ns - last_moved_ns >= cooldown_ns


def changed_readiness(before: DataFrame, changed_disks: DataFrame, placed: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Readiness after some disks changed: only logs with a shard on one of them are computed again, the others kept."""
    hit = placed.join(changed_disks.select("disk_id").distinct(), "disk_id", "left_semi").select("vlog_id").distinct()
    fresh = compute(placed.join(hit, "vlog_id", "left_semi"))
    return before.join(hit, "vlog_id", "left_anti").unionByName(fresh)


def daily(events: DataFrame, at: str = "at") -> DataFrame:
    """Newest event of each day, as retention by tumbling windows."""
    return events.groupBy(F.window(at, "1 day").alias("day")).agg(F.max(at).alias("newest"), F.count("*").alias("events"))
