"""Health of workers from pings and outcomes: keyed state on a stream, windows on a batch.

A worker starts unhealthy. A ping after silence makes it unhealthy until an outcome tells more; of its last ten outcomes more
than five system errors make it unhealthy, more than five timeouts unresponsive, otherwise it is healthy; ten seconds
without a ping make it offline.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

SILENCE_MS = 10_000
#: Rows that a task takes from a batch before it puts them into the state.
HELD = 5_000
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST, TOLERANCE = 10, 5
OUT = "worker string, ts timestamp, state string"


class Health:
    """State of one worker: recent outcomes and the last ping."""

    def __init__(self, outcomes: str = "", last_ping: int = -1, state: str = "unhealthy"):
        self.outcomes, self.last_ping, self.state = deque(outcomes, LAST), last_ping, state

    def _by_outcomes(self) -> str:
        if self.outcomes.count("e") > TOLERANCE:
            return "unhealthy"
        return "unresponsive" if self.outcomes.count("t") > TOLERANCE else "healthy"

    def see(self, ms: int, kind: str) -> list[tuple[int, str]]:
        """Changes of state that an event brings, an overdue silence before it first."""
        changes = self.silence(ms)
        before = self.state
        if kind == "ping":
            self.last_ping = ms
            if self.state == "offline":
                self.state = "unhealthy"
        else:
            self.outcomes.append({"success": "s", "error": "e", "timeout": "t"}.get(kind, "s"))
            if self.state != "offline":
                self.state = self._by_outcomes()
        return changes + ([(ms, self.state)] if self.state != before else [])

    def silence(self, now: int) -> list[tuple[int, str]]:
        if self.last_ping >= 0 and self.state != "offline" and now - self.last_ping > SILENCE_MS:
            self.state = "offline"
            return [(self.last_ping + SILENCE_MS, "offline")]
        return []


class HealthProcessor(StatefulProcessor):
    """Rows (worker, ms, kind) to changes of state, in event time. Rows wait in a map state by slots of time until the watermark has
    passed them; then a timer takes the slots in order, one in memory at a time. A batch's rows are read one by one and put into
    their slots ``HELD`` at a time, so neither a batch nor a worker's backlog is held. What comes out doesn't depend on how the rows
    were dealt into batches."""

    def __init__(self, slot_ms: int):
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.health = handle.getValueState("health", "outcomes string, last_ping bigint, state string")
        self.timer = handle.getValueState("timer", "at bigint")
        self.waiting = handle.getMapState("waiting", "slot bigint", "rows string")

    def _wake(self, at: int) -> None:
        now = self.timer.get()
        if now is not None and now[0] <= at:
            return
        if now is not None:
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _put(self, slots: dict[int, list[str]]) -> None:
        for slot, rows in slots.items():
            before = self.waiting.getValue((slot,))
            self.waiting.updateValue((slot,), (",".join([before[0], *rows] if before else rows),))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        slots: dict[int, list[str]] = {}
        held, first = 0, None
        for r in rows:
            slots.setdefault(r["ms"] // self.slot_ms, []).append(f"{r['ms']}:{r['kind']}")
            first = r["ms"] if first is None else min(first, r["ms"])
            held += 1
            if held >= HELD:
                self._put(slots)
                slots, held = {}, 0
        self._put(slots)
        if first is not None:
            self._wake(first + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        h = Health(*self.health.get()) if self.health.exists() else Health()
        self.timer.clear()
        ahead = None
        for slot in sorted(k[0] for k in self.waiting.keys()):
            if slot * self.slot_ms >= now:
                ahead = slot * self.slot_ms
                break
            rows = sorted((int(ms), kind) for ms, _, kind in (x.partition(":") for x in self.waiting.getValue((slot,))[0].split(",")))
            self.waiting.removeKey((slot,))
            later = [(ms, kind) for ms, kind in rows if ms >= now]
            for ms, kind in rows[: len(rows) - len(later)]:
                for at, state in h.see(ms, kind):
                    yield Row(worker=key[0], ms=at, state=state)
            if later:
                self._put({slot: [f"{ms}:{kind}" for ms, kind in later]})
                ahead = later[0][0]
                break
        for at, state in h.silence(now):
            yield Row(worker=key[0], ms=at, state=state)
        self.health.update(("".join(h.outcomes), h.last_ping, h.state))
        if ahead is not None:
            self._wake(max(ahead, now) + 1)
        if h.last_ping >= 0 and h.state != "offline":
            self._wake(max(h.last_ping + SILENCE_MS, now) + 1)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as keyed state with timers needs; a restart finds that in its checkpoint."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def health_changes(events: DataFrame, delay: str = "5 seconds", slot_ms: int = 60_000) -> DataFrame:
    """Stream of (worker, ts, kind: ping, success, error, timeout) to changes of state up to the watermark; start it inside rocksdb_state()."""
    rows = events.withWatermark("ts", delay).select("worker", "ts", F.unix_millis("ts").alias("ms"), "kind")
    out = rows.groupBy("worker").transformWithState(HealthProcessor(slot_ms), "worker string, ms bigint, state string", "Append", "EventTime")
    return out.select("worker", F.timestamp_millis("ms").alias("ts"), "state")


def health_by_window(events: DataFrame, worker: str = "worker", ts: str = "ts", kind: str = "kind", order: tuple[str, ...] = ()) -> DataFrame:
    """State of a worker after each outcome, by its last ten outcomes (batch form; pings and silence aside)."""
    w = Window.partitionBy(worker).orderBy(ts, *order).rowsBetween(1 - LAST, 0)
    out = events.where(F.col(kind) != "ping").withColumns({"errors": F.count_if(F.col(kind) == "error").over(w), "timeouts": F.count_if(F.col(kind) == "timeout").over(w)})
    return out.withColumn("state", F.when(F.col("errors") > TOLERANCE, "unhealthy").when(F.col("timeouts") > TOLERANCE, "unresponsive").otherwise("healthy"))
