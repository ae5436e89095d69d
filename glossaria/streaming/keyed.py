"""Keyed state with timers on streams of file events: prompts that are held back and made up for, tombstones that expire.

Both run as transformWithState in event time, so a restart from the checkpoint goes on where the state stood, and a key's
state is gone when its last timer has fired: what is kept follows the keys of the last hours, not all keys ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _ms(t) -> int:
    return round(t.timestamp() * 1000)


class Prompts(StatefulProcessor):
    """State of a folder: when it last prompted, how many saves wait. A save that comes too soon waits for the timer."""

    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("prompts", StructType([StructField("last", LongType()), StructField("waiting", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (Spark's names)
        last, waiting = self.state.get() if self.state.exists() else (None, 0)
        for t in sorted(_ms(r[1]) for r in rows):
            if waiting and t >= last + self.wait:  # the timer was due before this save
                last += self.wait
                yield self.prompt(key, last, waiting)
                waiting = 0
            if last is None or t >= last + self.wait:
                last = t
                yield self.prompt(key, t, 1)
            else:
                waiting += 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.wait)
        self.state.update((last, waiting))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        last, waiting = self.state.get()
        if not waiting:
            self.state.clear()
            return
        last += self.wait
        self.state.update((last, 0))
        self.handle.registerTimer(last + self.wait)
        yield self.prompt(key, last, waiting)

    @staticmethod
    def prompt(key, at: int, saves: int) -> Row:
        from datetime import datetime, timezone

        return Row(key=str(key[0]), at=datetime.fromtimestamp(at / 1000, tz=timezone.utc), saves=saves)

    def close(self) -> None:
        pass


def prompts(saves: DataFrame, by: str, ts: str = "ts", seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """A stream of (key, at, saves): a prompt at most every so many seconds per key; saves in between are prompted when the time is up."""
    out = StructType([StructField("key", StringType()), StructField("at", TimestampType()), StructField("saves", LongType())])
    named = saves.select(by, ts).withWatermark(ts, late)
    return named.groupBy(by).transformWithState(Prompts(seconds * 1000), out, "Append", "EventTime")


class Tombstones(StatefulProcessor):
    """State of a key: when it was deleted. It holds back writes for a while and is forgotten when its time to live is over."""

    def __init__(self, suppress_ms: int, live_ms: int):
        self.suppress, self.live = suppress_ms, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.deleted = handle.getValueState("deleted", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        at = self.deleted.get()[0] if self.deleted.exists() else None
        changed = False
        for t, gone, value in sorted(((_ms(r[1]), bool(r[2]), r[3]) for r in rows), key=lambda x: (x[0], not x[1], x[2] or "")):
            if gone:
                at, changed = t, True
            elif at is None or t >= at + self.suppress:
                yield Row(key=str(key[0]), value=value)
        if changed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.deleted.update((at,))
            self.handle.registerTimer(at + self.live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.deleted.clear()
        return iter(())

    def close(self) -> None:
        pass


def without_tombstones(events: DataFrame, suppress: int = 3600, live: int = 24 * 3600, late: str = "1 minute") -> DataFrame:
    """A stream of (key, value): writes of events (key, ts, deleted, value) that come so many seconds after the key's last deletion, if there was one."""
    out = StructType([StructField("key", StringType()), StructField("value", StringType())])
    named = events.select("key", "ts", "deleted", "value").withWatermark("ts", late)
    return named.groupBy("key").transformWithState(Tombstones(suppress * 1000, live * 1000), out, "Append", "EventTime")
