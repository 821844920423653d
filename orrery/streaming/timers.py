"""What happens when nothing happens: rows that get stuck, and sessions that end, by event-time timers of a stateful stream.

A key's state is a few numbers. Rows of a key are taken in the order of their times; a deadline that lies before the next row has passed by then, whether or not the watermark has reached it, so
that results don't depend on how rows are cut in batches. Timers are for keys that hear nothing more. Rows later than the watermark are dropped by the stream. Of one batch the times and
kinds of a key's rows are sorted in memory, those of sessions as arrays of 24 bytes a row since a few sessions may have all rows: `maxFilesPerTrigger` bounds a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config as C

#: Several state variables and timers need RocksDB; stores of a start that has ended are dropped when executors next look after them.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The settings of a stream with timers, for its time."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC)


class StuckRows(StatefulProcessor):
    """An asset that stays pending or processing for its minutes has failed: at the deadline, which every event moves or lifts."""

    def __init__(self, minutes: dict[str, int]):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, deadline long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, deadline = self.state.get() or (None, None)
        had = deadline
        for ms, _, new in sorted((r.ms, r.seq, r.status or "") for r in rows):
            if deadline is not None and ms > deadline:
                yield Row(assetId=key[0], was=status, failedAt=_time(deadline))
            status = new
            deadline = ms + self.minutes[new] * 60_000 if new in self.minutes else None
        if had is not None and had != deadline:
            self.handle.deleteTimer(had)
        if deadline is not None and had != deadline:
            self.handle.registerTimer(deadline)
        self.state.update((status, deadline))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, deadline = self.state.get() or (None, None)
        if deadline is not None and deadline <= expiredTimerInfo.getExpiryTimeInMs():
            yield Row(assetId=key[0], was=status, failedAt=_time(deadline))
            self.state.update(("failed", None))


def stuck_rows(events: DataFrame, late: str = "1 hour", minutes: dict[str, int] | None = None) -> DataFrame:
    """A stream of assetId, was and failedAt: when rows fail because nothing came. `events`: assetId, status, at, seq (which orders equal times)."""
    own = events.where(F.col("assetId").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    own = own.select("assetId", "status", "seq", "at", F.unix_millis("at").alias("ms"))
    return own.groupBy("assetId").transformWithState(StuckRows(minutes or C.STUCK_MINUTES), "assetId long, was string, failedAt timestamp", "Append", "EventTime")


class Sessions(StatefulProcessor):
    """Polls of a bulk session, folded as arrays: each keeps it alive for its time to live; its rate is sampled only when more has been completed since the last sample."""

    def __init__(self, live: int):
        self.live = live * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "started long, last long, polls long, completed long, recorded long, rate double")

    def _ended(self, key: tuple) -> tuple:
        started, last, polls, completed, _, rate = self.now
        return key[0], started, last + self.live, polls, completed, rate

    @staticmethod
    def _table(ended: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(ended, columns=["session", "startedAt", "endedAt", "polls", "completed", "rate"]).astype({"rate": "float64"})
        return out.assign(**{c: pd.to_datetime(out[c], unit="ms", utc=True) for c in ("startedAt", "endedAt")})

    def _take_in(self, ms: np.ndarray, done: np.ndarray) -> None:
        """Polls of one session in their order. The rate is that of the last one after the start that found more completed than all before it: the first with the greatest sum."""
        started, _, polls, completed, recorded, rate = self.now or (int(ms[0]), 0, 0, 0, 0, None)
        sums = completed + np.cumsum(done)
        found = np.where(ms > started, sums, np.iinfo(np.int64).min)
        at = int(found.argmax())
        if found[at] > recorded:
            recorded = int(found[at])
            rate = recorded * 1000 / (int(ms[at]) - started)
        self.now = (started, int(ms[-1]), polls + len(ms), int(sums[-1]), recorded, rate)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self.now = self.state.get()
        had, ended = self.now[1] + self.live if self.now else None, []
        ms, seq, done = (np.concatenate(c) for c in zip(*([part[c].to_numpy() for c in ("ms", "seq", "done")] for part in rows), strict=True))
        order = np.lexsort((done, seq, ms))
        ms, done = ms[order], done[order]
        cuts = np.flatnonzero(np.diff(ms) > self.live) + 1
        for own, more in zip(np.split(ms, cuts), np.split(done, cuts), strict=True):
            if self.now and own[0] > self.now[1] + self.live:
                ended.append(self._ended(key))
                self.now = None
            self._take_in(own, more)
        end = self.now[1] + self.live
        if had is not None and had != end:
            self.handle.deleteTimer(had)
        if had != end:
            self.handle.registerTimer(end)
        self.state.update(self.now)
        if ended:
            yield self._table(ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now = self.state.get()
        if self.now and self.now[1] + self.live <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._table([self._ended(key)])
            self.state.clear()


def sessions(polls: DataFrame, late: str = "1 hour", live: int = C.SESSION_TTL) -> DataFrame:
    """A stream of sessions that have ended: session, startedAt, endedAt, polls, completed, rate (a second). `polls`: session, at, seq, done (how many more are completed)."""
    own = polls.where(F.col("session").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    own = own.select("session", "at", "seq", F.coalesce(F.col("done"), F.lit(0)).cast("long").alias("done"), F.unix_millis("at").alias("ms"))
    return own.groupBy("session").transformWithStateInPandas(Sessions(live), "session long, startedAt timestamp, endedAt timestamp, polls long, completed long, rate double", "Append", "EventTime")


def run_slices(slices: list[DataFrame], process, home: str) -> DataFrame:
    """Feeds tables to a stream one after the other, each at a new start on one checkpoint, and returns all that came out. `process` makes the result of a stream; `home` is a shared folder."""
    spark, schema = slices[0].sparkSession, slices[0].schema
    with state_store(spark):
        for part in slices:
            part.write.mode("append").parquet(f"{home}/in")
            out = process(spark.readStream.schema(schema).parquet(f"{home}/in"))
            q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start(f"{home}/out")
            try:
                q.awaitTermination()
            finally:
                q.stop()
    return spark.read.schema(out.schema).parquet(f"{home}/out")
