"""Keyed state machines over event streams: transformWithState keeps each key's state in the state store, and event-time timers act when the watermark has passed.

Events of a stream may come late and repeated, and in any micro-batches. Each machine has a batch twin, a plan of windows and aggregates over a table of the same events; what a stream has
given when the watermark is past all events is what its twin gives. State is held by key and is let go by timers, so it does not grow with the stream's age.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A breaker opens at so many failures in a row, stays open so long after the last of them, and forgets failures so old.
FAILURES, OPEN_SECONDS, STALE_SECONDS = 5, 30, 60
#: States of delivery that a delay does not undo, and the delay.
DELIVERED, DELAYED = ("delivered_to_mail_server", "bounced", "failed"), "delivery_delayed"


def keep_state(spark: SparkSession) -> None:
    """The state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _millis(seconds: int) -> int:
    return seconds * 1000


class Deliveries(StatefulProcessor):
    """A message's status. State: the last event of all and the last that is no delay, by time and number, so late and repeated events change nothing that they should not."""

    FIELDS = "at long, seq long, status string, sure_at long, sure_seq long, sure string, ended boolean, version long"
    OUT = "key string, version long, status string, settled boolean"

    def __init__(self, terminal: tuple[str, ...], delayed: str, keep_seconds: int):
        self.terminal, self.delayed, self.keep_seconds = terminal, delayed, keep_seconds

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle, self.state = handle, handle.getValueState("message", self.FIELDS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        known = self.state.get() if self.state.exists() else (None, None, None, None, None, None, False, 0)
        at, seq, status, sure_at, sure_seq, sure, ended, version = known
        before = sure if ended else status
        for r in rows:
            now = (r["at"], r["seq"], r["status"])
            if at is None or now > (at, seq, status):
                at, seq, status = now
            if r["status"] != self.delayed and (sure_at is None or now > (sure_at, sure_seq, sure)):
                sure_at, sure_seq, sure = now
            ended = ended or r["status"] in self.terminal
        after = sure if ended else status
        version += after != before
        self.state.update((at, seq, status, sure_at, sure_seq, sure, ended, version))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(_millis(at + self.keep_seconds))
        if after != before:
            yield Row(key=key[0], version=version, status=after, settled=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        _, _, status, _, _, sure, ended, version = self.state.get()
        self.state.clear()
        yield Row(key=key[0], version=version, status=sure if ended else status, settled=True)

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, late: str, keep_seconds: int, terminal: tuple[str, ...] = DELIVERED, delayed: str = DELAYED) -> DataFrame:
    """key, version, status, settled: each change of a message's status, and once the last when nothing more is waited for.

    events: a stream of key (string), ts (timestamp), seq (long), status. Its batch twin is events.delivery_state.
    """
    keep_state(events.sparkSession)
    d = events.select("key", "ts", F.unix_timestamp("ts").alias("at"), "seq", "status").withWatermark("ts", late)
    return d.groupBy("key").transformWithState(Deliveries(terminal, delayed, keep_seconds), Deliveries.OUT, "append", "eventTime")


class Breaker:
    """A circuit breaker's periods from its calls in order; at: seconds."""

    def __init__(self, n: int = 0, last: int | None = None, start: int | None = None, trip: int | None = None, half: int | None = None):
        self.n, self.last, self.start, self.trip, self.half = n, last, start, trip, half

    def passed(self, at: int) -> Iterator[tuple[str, int, int]]:
        """Periods that have ended by `at`, no call being made meanwhile."""
        if self.start is not None and at >= self.trip + OPEN_SECONDS:
            yield "open", self.start, self.trip + OPEN_SECONDS
            self.start, self.half = None, self.trip + OPEN_SECONDS if self.n else None
        if self.half is not None and at >= self.trip + STALE_SECONDS:
            yield "half_open", self.half, self.trip + STALE_SECONDS
            self.half = None

    def call(self, at: int, failed: bool) -> Iterator[tuple[str, int, int]]:
        yield from self.passed(at)
        if self.half is not None and at > self.half:
            yield "half_open", self.half, at
        self.half = None
        if not failed:
            self.n, self.last = 0, None
            return
        self.n = 1 if self.last is not None and at - self.last > STALE_SECONDS else self.n + 1
        self.last = at
        if self.n >= FAILURES:
            self.start, self.trip = at if self.start is None else self.start, at


class Breakers(StatefulProcessor):
    """Calls wait in the state until the watermark has passed them; then they are made in order of time and number. Timers also stand at the times at which an open and a half-open period end."""

    CALLS, STATE = "at long, seq long, failed boolean", "n long, last long, start long, trip long, half long"
    OUT = "key string, state string, began long, ended long"

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle, self.calls, self.state = handle, handle.getListState("calls", self.CALLS), handle.getValueState("breaker", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        for r in rows:
            self.calls.appendValue((r["at"], r["seq"], r["failed"]))
            self.handle.registerTimer(_millis(r["at"]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        waiting = sorted({tuple(c) for c in self.calls.get()}) if self.calls.exists() else []  # a repeated call counts once
        due = [c for c in waiting if c[0] <= now]
        breaker, out = Breaker(*(self.state.get() if self.state.exists() else ())), []
        for at, _, failed in due:
            out += breaker.call(at, failed)
        out += breaker.passed(now)
        if due:
            self.calls.clear()
            if len(due) < len(waiting):
                self.calls.put(waiting[len(due) :])
        if breaker.start is not None:
            self.handle.registerTimer(_millis(breaker.trip + OPEN_SECONDS))
        elif breaker.half is not None:
            self.handle.registerTimer(_millis(breaker.trip + STALE_SECONDS))
        if breaker.n and breaker.last is not None and now - breaker.last <= STALE_SECONDS:
            self.state.update((breaker.n, breaker.last, breaker.start, breaker.trip, breaker.half))
            self.handle.registerTimer(_millis(breaker.last + STALE_SECONDS + 1))  # when the failures are forgotten
        elif breaker.start is not None or breaker.half is not None:
            self.state.update((breaker.n, breaker.last, breaker.start, breaker.trip, breaker.half))
        else:
            self.state.clear()
        for state, began, ended in out:
            yield Row(key=key[0], state=state, began=began, ended=ended)

    def close(self) -> None:
        pass


def breakers(calls: DataFrame, late: str) -> DataFrame:
    """key, state, began, ended (seconds): open and half-open periods of each key's breaker; at other times it is closed. calls: a stream of key (string), ts (timestamp), seq, failed."""
    keep_state(calls.sparkSession)
    d = calls.select("key", "ts", F.unix_timestamp("ts").alias("at"), "seq", "failed").withWatermark("ts", late)
    return d.groupBy("key").transformWithState(Breakers(), Breakers.OUT, "append", "eventTime")


def breaker_periods(calls: DataFrame, key: str, at: str, seq: str, failed: str) -> DataFrame:
    """Batch twin of breakers(): key, state, began, ended.

    Failures are numbered since the last success or longer gap; those from FAILURES on trip the breaker, trips less than OPEN_SECONDS apart keep it open. When it closes it is half open until the next call, if none
    came before, but not longer than the failures count.
    """
    w = W.partitionBy("key").orderBy("at", "seq")
    d = calls.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(seq).alias("seq"), F.col(failed).alias("failed")).distinct()
    fresh = F.lag("at").over(w).isNull() | ~F.lag("failed").over(w) | (F.col("at") - F.lag("at").over(w) > STALE_SECONDS)
    d = d.withColumn("run", F.sum(fresh.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("next", F.lead("at").over(w))
    d = d.where("failed").withColumn("n", F.row_number().over(W.partitionBy("key", "run").orderBy("at", "seq"))).where(F.col("n") >= FAILURES)
    apart = F.coalesce(F.col("at") - F.lag("at").over(w) >= OPEN_SECONDS, F.lit(True))
    d = d.withColumn("island", F.sum(apart.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.groupBy("key", "island").agg(F.min("at").alias("began"), F.max(F.struct("at", "seq", "next")).alias("x")).withColumn("ended", F.col("x.at") + OPEN_SECONDS)
    until = F.least(F.coalesce("x.next", F.col("x.at") + STALE_SECONDS), F.col("x.at") + STALE_SECONDS)
    half = d.where(F.col("x.next").isNull() | (F.col("x.next") > F.col("ended"))).select("key", F.lit("half_open").alias("state"), F.col("ended").alias("began"), until.alias("ended"))
    return d.select("key", F.lit("open").alias("state"), "began", "ended").unionByName(half)


class Sweep(StatefulProcessor):
    """What a sweep removes: a row's state is made, may be marked used, and goes at the first sweep after its time."""

    STATE, OUT = "due long, used boolean", "key string, swept_at long"

    def __init__(self, every: int, keep: int, only_used: bool):
        self.every, self.keep, self.only_used = every, keep, only_used

    def init(self, handle) -> None:  # noqa: ANN001
        self.handle, self.state = handle, handle.getValueState("row", self.STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        due, used = self.state.get() if self.state.exists() else (None, False)
        for r in rows:
            used = used or bool(r["used"])
            if r["expires_at"] is not None:
                due = max(due or 0, r["expires_at"] + self.keep)
        self.state.update((due, used))
        if due is not None and (used or not self.only_used):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            at = -(-(due + 1) // self.every) * self.every  # the first sweep that finds it past its time
            now = timerValues.getCurrentWatermarkInMs() // 1000
            self.handle.registerTimer(_millis(max(at, -(-(now + 1) // self.every) * self.every)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        self.state.clear()
        yield Row(key=key[0], swept_at=expiredTimerInfo.getExpiryTimeInMs() // 1000)

    def close(self) -> None:
        pass


def sweeps(rows: DataFrame, late: str, every: int, keep: int = 0, only_used: bool = False) -> DataFrame:
    """key, swept_at (seconds): each row that sweeps remove, once. rows: a stream of key (string), ts (timestamp), expires_at (seconds or null), used (boolean)."""
    keep_state(rows.sparkSession)
    d = rows.select("key", "ts", "expires_at", "used").withWatermark("ts", late)
    return d.groupBy("key").transformWithState(Sweep(every, keep, only_used), Sweep.OUT, "append", "eventTime")


def swept(rows: DataFrame, now: int | Column, every: int, keep: int = 0, only_used: bool = False) -> DataFrame:
    """Batch twin of sweeps(): key, swept_at of what sweeps up to `now` (seconds) remove."""
    d = rows.groupBy("key").agg((F.max("expires_at") + keep).alias("due"), F.max(F.coalesce("used", F.lit(False))).alias("used"))
    at = (F.ceil((F.col("due") + 1) / every) * every).alias("swept_at")
    return d.where(F.col("used") if only_used else F.lit(True)).select("key", at).where(F.col("swept_at") <= now)
