"""Streams with state of their own: sessions closed by event-time timers, and first deliveries told by state that expires."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, LongType, StructType

from tessera.ship import shipped
from tessera.streaming.events import _two_deliveries, delivered, plain

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Groups of `first_seen`; each call holds one group's ids of the time that they are kept.
GROUPS = 1024
#: first, last, n, event types
Session = tuple[int, int, int, set[str]]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back at the end."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class TimedSessions(StatefulProcessor):
    """Sessions of a key: events with pauses below the gap; one comes out, with its place among the key's sessions, once the watermark has passed its end.

    State: the open sessions (first, last, n) in arrays, the event types of each, and the number of sessions that have
    left. Each is read and written once a call, since a call to the state costs a message to the executor's JVM. Timers
    stand at the first and the last end of the open sessions, however many there are: the first to fire closes all
    sessions that the watermark has passed, which leave the state, so a key without open sessions holds one number.
    Events may come in any order: sessions that a late event joins are merged. Rows behind the watermark join only
    sessions that are still open.
    """

    def __init__(self, gap: int):
        self.gap = gap  # microseconds, as all times here but those of timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first array<long>, last array<long>, n array<long>")
        self.kinds = handle.getValueState("kinds", "first array<long>, kind array<string>")
        self.left = handle.getValueState("left", "n long")

    def _held(self) -> list[Session]:
        """The open sessions by their first times; the last field has the event types."""
        parts = self.open.get()
        if not parts:
            return []
        kinds: dict[int, set[str]] = {}
        for first, kind in zip(*self.kinds.get(), strict=True):
            kinds.setdefault(first, set()).add(kind)
        return [(first, last, n, kinds[first]) for first, last, n in zip(*parts, strict=True)]

    def _hold(self, held: list[Session], before: set[int], gone: int | None = None) -> None:
        """Keep the sessions and move the timers from before to their ends; the one at gone is firing, and Spark takes it away."""
        if held:
            self.open.update(tuple([s[i] for s in held] for i in range(3)))
            pairs = [(s[0], kind) for s in held for kind in sorted(s[3])]
            self.kinds.update(([first for first, _ in pairs], [kind for _, kind in pairs]))
        else:
            self.open.clear()
            self.kinds.clear()
        after = self._timers(held)
        for at in before - after - {gone}:
            self.handle.deleteTimer(at)
        for at in after - before:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = self._timers(held)
        for frame in rows:
            fresh = [(t, t, 1, {kind}) for t, kind in zip(frame["at_us"].tolist(), frame["kind"].tolist(), strict=True)]
            held = self._merged(sorted([*held, *fresh], key=lambda s: s[:2]))
        self._hold(held, before)
        return iter(())

    def _timer(self, session: Session) -> int:
        """The first millisecond at or after the session's end."""
        return -(-(session[1] + self.gap) // 1000)

    def _timers(self, held: list[Session]) -> set[int]:
        return {self._timer(held[0]), self._timer(held[-1])} if held else set()

    def _merged(self, parts: list[Session]) -> list[Session]:
        """Sessions of parts in order."""
        out: list[Session] = []
        for first, last, n, kinds in parts:
            if out and first - out[-1][1] < self.gap:
                a, b, m, own = out[-1]
                out[-1] = (a, max(b, last), m + n, own | kinds)
            else:
                out.append((first, last, n, kinds))
        return out

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        upto = max(at, timerValues.getCurrentWatermarkInMs()) if timerValues else at
        held = self._held()
        done = [s for s in held if self._timer(s) <= upto]
        if not done:  # the other timer has closed them
            return
        self._hold([s for s in held if self._timer(s) > upto], self._timers(held), at)
        number = (self.left.get() or (0,))[0]
        self.left.update((number + len(done),))
        yield pd.DataFrame([(key[0], first, last, n, len(kinds), number + i) for i, (first, last, n, kinds) in enumerate(done, 1)], columns=["key", "first", "last", "n", "kinds", "number"])

    def close(self) -> None:
        pass


def timed_sessions(stream: DataFrame, key: str, at: str, kind: str, gap_seconds: int) -> DataFrame:
    """key, first, last, n, kinds (how many different ones), number (1, 2, 3... within the key): a row for each session that the watermark of stream has passed.

    stream has a watermark on `at`, a timestamp. Rows without a key or time are left out.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.col(at), F.unix_micros(at).alias("at_us"), F.coalesce(F.col(kind), F.lit("")).alias("kind"))
    schema = StructType().add("key", rows.schema["key"].dataType).add("first", "long").add("last", "long").add("n", "long").add("kinds", "long").add("number", "long")
    found = rows.groupBy("key").transformWithStateInPandas(TimedSessions(gap_seconds * 1_000_000), schema, "Append", "EventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "kinds", "number")


class FirstSeen(StatefulProcessor):
    """The first row of each (key, id); they are forgotten `keep_ms` after they came, so the state holds those of that time alone.

    State: a list of what was fresh in each call, in arrays that expire together, as they came together. A call reads
    the group's list and appends once, since each call to the state costs a message to the executor's JVM.
    """

    def __init__(self, keep_ms: int, key_type: DataType):
        self.keep_ms, self.key_type = keep_ms, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", StructType().add("keys", ArrayType(self.key_type)).add("ids", ArrayType(LongType())), ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seen = {pair for keys, ids in self.seen.get() for pair in zip(keys, ids, strict=True)}
        came: list[tuple[Any, int]] = []
        for frame in rows:
            fresh = list(dict.fromkeys(pair for pair in zip(frame["key"].tolist(), frame["id"].tolist(), strict=True) if pair not in seen))
            seen.update(fresh)
            came += fresh
            if fresh:
                yield pd.DataFrame(fresh, columns=["key", "id"])
        if came:
            self.seen.appendValue(([k for k, _ in came], [i for _, i in came]))

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, key: str, id_col: str, keep_seconds: int, groups: int = GROUPS) -> DataFrame:
    """key and id of the rows of stream whose id has not come within keep_seconds of clock time; rows without a key or id are left out.

    Rows are dealt to groups by the hash of key and id: many small keys share a call, and a hot key is spread.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(id_col).isNotNull()).select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"))
    dealt = rows.withColumn("dealt", F.pmod(F.xxhash64("key", "id"), F.lit(groups)))
    found = dealt.groupBy("dealt").transformWithStateInPandas(FirstSeen(keep_seconds * 1000, rows.schema["key"].dataType), rows.schema, "Append", "ProcessingTime")
    return found.select(F.col("key").alias(key), F.col("id").alias(id_col))


def numbered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users over two deliveries; the second is a new run that goes on from the state of the first."""
    with rocksdb(shipped(spark)):
        found = delivered(list(_two_deliveries(spark, sf_dir)), lambda s: timed_sessions(s.withWatermark("ts", "1 hour"), "user_id", "ts", "event_type", 3600))
    return found.select("user_id", plain(F.col("first")).alias("start"), plain(F.col("last")).alias("finish"), "n", "kinds", "number")


def events_seen_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery has its events twice, and the second has the whole first again: each id comes out once."""
    first, second = _two_deliveries(spark, sf_dir)
    with rocksdb(shipped(spark)):
        found = delivered([first.unionByName(first), second.unionByName(first)], lambda s: first_seen(s, "user_id", "event_id", 86_400), once=True)
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))
