"""Alerts that are current until dismissed or old, kept as state by key; a digest of what was missed; snapshots with a lifetime."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tremor import constants as K
from tremor.operators.upsert import get_state, put_state

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ALERT = "key string, change string, event_id string, magnitude double, time_ms long, at_ms long"
SEEN_THROUGH = "seen_through"


def alert_processor(minimum: float, age_ms: int) -> StatefulProcessor:
    """State of one key: the ids announced, for as long as they could be announced again, and the current alert."""

    class Alerts(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.announced = handle.getMapState("announced", "event_id string", "time_ms long")
            self.current = handle.getValueState("current", "event_id string, magnitude double, time_ms long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator:
            from pyspark.sql import Row

            def out(change, event, at):
                return Row(key=key[0], change=change, event_id=event[0], magnitude=event[1], time_ms=event[2], at_ms=at)

            rows = sorted(rows, key=lambda r: (r.at_ms, r.kind != "event"))
            now = max(r.at_ms for r in rows)
            best = None
            for r in rows:
                if r.kind == "event" and r.magnitude is not None and r.magnitude >= minimum and r.time_ms is not None and now - r.time_ms <= age_ms:
                    if not self.announced.containsKey((r.event_id,)) and (best is None or (r.time_ms, r.event_id) > (best[2], best[0])):
                        best = (r.event_id, r.magnitude, r.time_ms)
            dismissals = [r.at_ms for r in rows if r.kind == "dismiss"]
            if dismissals and self.current.exists():
                held = tuple(self.current.get())
                self.current.clear()
                yield out("dismissed", held, max(dismissals))
            if best is not None:
                self.announced.updateValue((best[0],), (best[2],))
                self.current.update(best)
                self.handle.registerTimer(best[2] + age_ms + 1)
                yield out("announced", best, now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
            from pyspark.sql import Row

            at = expiredTimerInfo.getExpiryTimeInMs()
            for (event_id,), (time_ms,) in [(tuple(k), tuple(v)) for k, v in self.announced.iterator()]:
                if time_ms + age_ms < at:  # too old to be announced again
                    self.announced.removeKey((event_id,))
            if self.current.exists():
                held = tuple(self.current.get())
                if held[2] + age_ms < at:
                    self.current.clear()
                    yield Row(key=key[0], change="expired", event_id=held[0], magnitude=held[1], time_ms=held[2], at_ms=at)

        def close(self) -> None:
            pass

    return Alerts()


def alert_changes(inputs: DataFrame, *, minimum: float = K.ALERT_MAGNITUDE, age_minutes: int = K.ALERT_AGE_MINUTES, late: str = "0 seconds") -> DataFrame:
    """Changes of the current alert of each key, from a stream (key, kind, event_id, magnitude, time_ms, at_ms).

    Of a batch's large events (kind `event`) that are not too old and were not announced before, the newest is announced and becomes
    current; an event without a time is none, one from a clock ahead is new. `dismiss` takes the current alert away but not
    the memory that it was announced. Time is that of `at_ms`; where it passes an alert's age, the alert expires. Small events,
    which are most, are left out before the shuffle. Needs the RocksDB state store.
    """
    worth = inputs.where((F.col("kind") == "dismiss") | ((F.col("kind") == "event") & (F.col("magnitude") >= minimum) & F.col("time_ms").isNotNull()))
    timed = worth.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("key").transformWithState(alert_processor(minimum, age_minutes * 60_000), ALERT, "Append", "EventTime")


def current_alerts(changes: DataFrame) -> DataFrame:
    """The alert that stands for each key after changes that were kept; no row where none does."""
    order = F.struct("at_ms", F.when(F.col("change") == "announced", 1).otherwise(0))
    last = changes.groupBy("key").agg(F.max_by(F.struct("change", "event_id", "magnitude", "time_ms"), order).alias("l"))
    return last.where(F.col("l.change") == "announced").select("key", "l.event_id", "l.magnitude", "l.time_ms")


def digest(events: DataFrame, state: DataFrame, *, minimum: float = K.MISSED_MAGNITUDE, limit: int = K.MISSED_LIMIT) -> DataFrame:
    """What happened since the last mark: one row (since_ms, total, events: the largest `limit`, ties newest first).

    No row where there is no mark yet (a first start has missed nothing) or nothing large came after it; the mark's own instant is seen.
    """
    since = get_state(state, SEEN_THROUGH).select(F.col("value").try_cast("long").alias("since_ms")).where("since_ms is not null")
    missed = events.where(F.col("magnitude") >= minimum).join(F.broadcast(since), F.col("time_ms") > F.col("since_ms"))
    total = missed.groupBy("since_ms").agg(F.count("*").alias("total"))
    top = missed.orderBy(F.desc("magnitude"), F.desc("time_ms"), "event_id").limit(limit)
    order = F.struct((-F.col("magnitude")).alias("m"), (-F.col("time_ms")).alias("t"), "event_id", "magnitude", "time_ms")
    listed = top.groupBy("since_ms").agg(F.transform(F.sort_array(F.collect_list(order)), lambda s: F.struct(s["event_id"].alias("event_id"), s["magnitude"].alias("magnitude"), s["time_ms"].alias("time_ms"))).alias("events"))
    return total.join(listed, "since_ms")


def on_start(events: DataFrame, state: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The digest, and the state with everything up to now marked as seen; the caller writes the state once the digest is shown."""
    return digest(events, state), put_state(state, SEEN_THROUGH, str(now_ms), now_ms)


class Snapshots:
    """The last states of something that is fetched whole, such as a map: folders named by the instant of fetching.

    latest() answers from the newest while it is within its lifetime, else fetches anew; askers at the same time share one fetch.
    Where fetching fails, the stale snapshot answers, and its instant says how old it is. All but the last `keep` are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, fetch: Callable[[], DataFrame], lifetime_ms: int, clock: Callable[[], int], keep: int = 2):
        self.spark, self.path, self.fetch, self.lifetime_ms, self.clock, self.keep = spark, path.rstrip("/"), fetch, lifetime_ms, clock, max(1, keep)
        self._turn = threading.Lock()
        self.error: str | None = None

    def _fs(self, path: str):
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), fs_path

    def held(self) -> list[int]:
        fs, top = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[3:]) for n in names if n.startswith("at=") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1]))

    def _read(self, at: int) -> tuple[int, DataFrame]:
        return at, self.spark.read.parquet(f"{self.path}/at={at}")

    def latest(self) -> tuple[int, DataFrame] | None:
        """(instant of fetching, rows), or None where nothing was ever fetched and fetching fails."""
        asked = self.clock()
        with self._turn:
            held = self.held()
            if held and asked - held[-1] < self.lifetime_ms:  # also what another asker has fetched meanwhile
                return self._read(held[-1])
            try:
                at = self.clock()
                self.fetch().write.mode("overwrite").parquet(f"{self.path}/at={at}")
                self.error = None
            except Exception as e:
                self.error = str(e)
                return self._read(held[-1]) if held else None
            for old in self.held()[: -self.keep]:
                fs, path = self._fs(f"{self.path}/at={old}")
                fs.delete(path, True)
            return self._read(at)
