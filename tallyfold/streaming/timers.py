"""The refresh ladder as a stateful processor with event-time timers.

``stream_due`` keeps an account's step of the ladder as typed state in RocksDB.  A scan
moves it and sets a timer at the time the next scan is due; when the watermark passes
that time without a new scan, the processor itself emits a row that the account is due.
A second timer lets state end that no scan has touched for long.  Both timers' times are
part of the state, so that a scan changes those two alone and lists none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .folds import EXPIRE_AFTER

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind: "scan" after a batch with scans of the account, "due" when its time has come.
DUE = "account_id long, kind string, stage int, next_due_s long"
_STATE = "shown string, owner boolean, stage int, last long, due long, ends long, wakes long"


class RefreshTimers(StatefulProcessor):
    """Moves an account on the ladder and wakes when its next scan is due (times in seconds)."""

    def __init__(self, schedule: list[int], stagger: int = 900):
        self.schedule, self.stagger = schedule, stagger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ladder", _STATE)

    def _at(self, seconds: int, watermark_ms: int) -> int:
        """A timer time: event time must be ahead of the watermark."""
        return max(1000 * seconds, watermark_ms + 1)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        held = self.state.get()
        shown, owner, stage, last, due, ends, wakes = held or ("", False, -1, 0, 0, 0, 0)
        for at, _, now, ok in sorted((r["at"], r["scan_id"], r["now"], r["ok"]) for r in rows):
            owner = bool(owner or now)
            if owner and ok:
                stage = 0 if now != shown or stage < 0 else min(stage + 1, len(self.schedule) - 1)
                last = at
            shown = now
        watermark = timerValues.getCurrentWatermarkInMs()
        before = {t for t in (ends, wakes) if t}
        ends = self._at(at + EXPIRE_AFTER * max(self.schedule), watermark)
        if stage >= 0:
            due = last + self.schedule[stage] + key[0] % self.stagger
            wakes = self._at(due, watermark)
        after = {t for t in (ends, wakes) if t}
        for timer in before - after:
            self.handle.deleteTimer(timer)
        for timer in after - before:
            self.handle.registerTimer(timer)
        self.state.update((shown, owner, stage, last, due, ends, wakes))
        if stage >= 0:
            yield Row(account_id=key[0], kind="scan", stage=stage, next_due_s=due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        held = self.state.get()
        if not held:
            return
        shown, owner, stage, last, due, ends, _ = held
        if expiredTimerInfo.getExpiryTimeInMs() >= ends:
            self.state.clear()
        elif stage >= 0:
            self.state.update((shown, owner, stage, last, due, ends, 0))
            yield Row(account_id=key[0], kind="due", stage=stage, next_due_s=due)

    def close(self) -> None:
        pass


def stream_due(scans: DataFrame, schedule: list[int], late: str = "1 day") -> DataFrame:
    """DUE rows: an account's step after each batch that holds scans of it, and when it is due.

    Scans of an account come in order of time.  The session's state store must be RocksDB
    (``rocks_db``).
    """
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    now = F.when(ok & F.col("keys").isNotNull(), F.array_join(F.array_sort(F.array_distinct("keys")), ",")).otherwise("")
    rows = scans.withWatermark("observed_at", late).select("account_id", "observed_at", "scan_id", F.unix_timestamp("observed_at").alias("at"), now.alias("now"), ok.alias("ok"))
    return rows.groupBy("account_id").transformWithState(statefulProcessor=RefreshTimers(schedule), outputStructType=DUE, outputMode="Update", timeMode="EventTime")


@contextmanager
def rocks_db(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        if before:
            spark.conf.set(PROVIDER, before)
        else:
            spark.conf.unset(PROVIDER)
