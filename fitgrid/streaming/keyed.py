"""Keyed state streams: admissions, budgets and leases.

Rows of a key are taken in (time, id) order within a micro-batch; across
batches the order of arrival counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType


def _in_time(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: (r.us, r.event_id))


class RollingAdmission(StatefulProcessor):
    """Admits a key's request while fewer than ``limit`` were admitted in the window.

    State is the list of admitted (time, item), never longer than the limit.
    """

    def __init__(self, limit: int, window_us: int, item_type: str):
        self.limit, self.window_us, self.item_type = limit, window_us, item_type

    def init(self, handle) -> None:
        self.slots = handle.getListState("slots", f"us bigint, item {self.item_type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        slots = [(us, item) for us, item in self.slots.get()]
        out = []
        for r in _in_time(rows):
            slots = [s for s in slots if s[0] >= r.us - self.window_us]
            if any(item == r.item for _, item in slots):
                decision = "repeat"
            elif len(slots) < self.limit:
                decision = "admitted"
                slots.append((r.us, r.item))
            else:
                decision = "rejected"
            out.append(Row(key=key[0], event_id=r.event_id, decision=decision))
        self.slots.put(slots) if slots else self.slots.clear()
        return iter(out)

    def close(self) -> None:
        pass


class DailyBudget(StatefulProcessor):
    """Reserves units of a day while the total stays within the limit; skips what does not fit.

    The total goes when the watermark has passed the day: no reservation of it can follow.
    """

    def __init__(self, daily_limit: int):
        self.daily_limit = daily_limit

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "units bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if self.total.exists():
            total = self.total.get()[0]
        else:
            total = 0
            self.handle.registerTimer((key[0] + 1) * 86_400_000)
        out = []
        for r in _in_time(rows):
            fits = total + r.item <= self.daily_limit
            total += r.item if fits else 0
            out.append(Row(key=key[0], event_id=r.event_id, decision="reserved" if fits else "skipped"))
        self.total.update((total,))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.total.clear()
        return iter([])

    def close(self) -> None:
        pass


class LeaseExpiry(StatefulProcessor):
    """Job changes → an outcome when no renewal arrives before the lease ends.

    ``item`` is the lease length in seconds, 0 for a completed job. The timer
    of the last lease fires when the watermark passes it.
    """

    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "until_ms bigint, attempts int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out = []
        until, attempts = self.lease.get() if self.lease.exists() else (0, 0)
        for r in _in_time(rows):
            now = r.us // 1000
            if until and now > until:
                out.append(self._expired(key, until, attempts))
                until = 0
            if r.item == 0:
                if until:
                    out.append(Row(key=key[0], at_ms=now, outcome="completed", attempts=attempts))
                until, attempts = 0, 0
            else:
                attempts += 0 if until else 1
                until = now + r.item * 1000
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if until:
            self.handle.registerTimer(until)
        self._keep(until, attempts)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until, attempts = self.lease.get() if self.lease.exists() else (0, 0)
        if not until:
            return iter([])
        self._keep(0, attempts if attempts < self.max_attempts else 0)
        return iter([self._expired(key, until, attempts)])

    def _keep(self, until: int, attempts: int) -> None:
        """A job that is done for, one way or the other, leaves no state; one that waits again keeps its attempts."""
        if until or attempts:
            self.lease.update((until, attempts))
        else:
            self.lease.clear()

    def _expired(self, key, until, attempts) -> Row:
        outcome = "failed" if attempts >= self.max_attempts else "requeued"
        return Row(key=key[0], at_ms=until, outcome=outcome, attempts=attempts)

    def close(self) -> None:
        pass


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _decisions(rows: DataFrame) -> str:
    return f"key {_type(rows, 'key')}, event_id {_type(rows, 'event_id')}, decision string"


def _state(stream: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    return stream.groupBy("key").transformWithState(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(schema), outputMode="Append",
        timeMode=time_mode)


def admission_stream(requests: DataFrame, key: str, limit: int, window_seconds: int, item: str | None = None) -> DataFrame:
    rows = requests.select(
        F.col(key).alias("key"), F.unix_micros("ts").alias("us"), "event_id", F.col(item or "event_id").alias("item"))
    processor = RollingAdmission(limit, window_seconds * 1_000_000, _type(rows, "item"))
    return _state(rows, processor, _decisions(rows)).withColumnRenamed("key", key)


def budget_stream(reservations: DataFrame, daily_limit: int, late: str = "10 minutes") -> DataFrame:
    """Reservations per UTC day; the key is the day's number. Rows that come later than ``late`` are dropped."""
    rows = reservations.withWatermark("ts", late).select(
        F.unix_date(F.to_date("ts")).cast("bigint").alias("key"), F.unix_micros("ts").alias("us"), "event_id", "ts",
        F.col("units").cast("bigint").alias("item"))
    return _state(rows, DailyBudget(daily_limit), _decisions(rows), "EventTime").select(
        F.date_from_unix_date(F.col("key").cast("int")).alias("usage_date"), "event_id",
        (F.col("decision") == "reserved").alias("reserved"))


def lease_stream(changes: DataFrame, max_attempts: int, late: str = "10 minutes") -> DataFrame:
    """(job_id, ts, event_id, lease_seconds) → completed, requeued and failed outcomes."""
    rows = changes.withWatermark("ts", late).select(
        F.col("job_id").alias("key"), F.unix_micros("ts").alias("us"), "event_id", "ts",
        F.col("lease_seconds").cast("bigint").alias("item"))
    leases = f"key {_type(rows, 'key')}, at_ms bigint, outcome string, attempts int"
    return _state(rows, LeaseExpiry(max_attempts), leases, "EventTime").select(
        F.col("key").alias("job_id"), F.timestamp_millis("at_ms").alias("at"), "outcome", "attempts")
