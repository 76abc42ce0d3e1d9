"""Structured Streaming twins of the batch operators, on event time.

Streams hold envelope rows with ``ts`` (timestamp) beside ``us``; ``watch`` sets the watermark.
State of ``bursts``, ``latest_answers`` and ``shed`` is dropped by event-time timers once it can no
longer change a result, so what they give is what the batch operators give, however far the
watermark moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.operators.govern import TIERS, TieredBucket


def tail(spark: SparkSession, path: str, schema, session: str | None = None, files: int = 100) -> DataFrame:
    """The growing event table as a stream, ``files`` a trigger at most; resumes from its checkpoint."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows if session is None else rows.where(F.col("session") == session)


def watch(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay)


def once_each(events: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that a resumed source delivers again are dropped within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


def _keep_until(state, us: float) -> None:
    """Ask for the timer that drops the state at a time; never before the watermark."""
    state.setTimeoutTimestamp(max(int(us // 1000) + 1, state.getCurrentWatermarkMs() + 1))


def first_contacts(events: DataFrame, contact: Column, idle_us: int = 30 * 86_400_000_000) -> DataFrame:
    """session, contact, row_id and us of the first event of each (session, contact).

    A contact is known until it has not been seen for ``idle_us``, whatever the watermark.
    """
    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["us", "row_id"])
        if not state.exists:
            yield pd.DataFrame([(*key, int(rows.row_id.iloc[0]), int(rows.us.iloc[0]))], columns=["session", "contact", "row_id", "us"])
        state.update((True,))
        _keep_until(state, int(rows.us.iloc[-1]) + idle_us)

    rows = events.withColumn("contact", contact).where("contact is not null and contact != ''").select("session", "contact", "row_id", "us", "ts")
    return rows.groupBy("session", "contact").applyInPandasWithState(update, "session string, contact string, row_id long, us long", "seen boolean", "append", "EventTimeTimeout")


def correlate(reads: DataFrame, domains: DataFrame, seconds: int) -> DataFrame:
    """Reads and first contacts of one session within the window, as a stream-stream join; both sides carry a watermark."""
    r = reads.select(F.col("session").alias("r_session"), F.col("row_id").alias("read_id"), F.col("ts").alias("r_ts"), F.col("path"))
    d = domains.select(F.col("session"), F.col("row_id").alias("contact_id"), F.col("ts").alias("d_ts"), F.col("contact").alias("host"))
    span = F.expr(f"r_session = session AND r_ts BETWEEN d_ts - INTERVAL {seconds} SECONDS AND d_ts + INTERVAL {seconds} SECONDS")
    return r.join(d, span).select("session", "read_id", "contact_id", "path", "host", F.greatest("r_ts", "d_ts").alias("ts"))


def loss_windows(shed: DataFrame, every: str = "5 seconds") -> DataFrame:
    """Lost events by session, class and flush interval."""
    return shed.groupBy("session", "class", F.window("ts", every)).count()


def split_late(batch: DataFrame, newest_us: int, delay_us: int) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows later than the delay allows), for a side table in ``foreachBatch``."""
    late = F.col("us") < newest_us - delay_us
    return batch.where(~late), batch.where(late)


def bursts(events: DataFrame, cls: Column, window_us: int, threshold: int) -> DataFrame:
    """Edge-triggered bursts by session and class. State: the times inside the window, never more than the threshold, and whether armed; after a window without events both are as at the start."""
    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, armed = state.get if state.exists else ([], True)
        times, out = list(times), []
        rows = pd.concat(list(batches)).sort_values(["us", "row_id"])
        for us, row in zip(rows.us.tolist(), rows.row_id.tolist()):
            times = [t for t in times if t > us - window_us][-(threshold - 1) :] + [us] if threshold > 1 else [us]
            full = len(times) >= threshold
            if full and armed:
                out.append((key[0], key[1], row, us))
            armed = not full
        state.update((times, armed))
        _keep_until(state, times[-1] + window_us)
        yield pd.DataFrame(out, columns=["session", "burst_class", "row_id", "us"])

    rows = events.withColumn("burst_class", cls).where("burst_class is not null").select("session", "burst_class", "row_id", "us", "ts")
    return rows.groupBy("session", "burst_class").applyInPandasWithState(update, "session string, burst_class string, row_id long, us long", "times array<long>, armed boolean", "append", "EventTimeTimeout")


def segments(events: DataFrame, size: int, age_us: int) -> DataFrame:
    """Segment numbers by count or age; a session's state goes with its session.end event."""
    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seg, n, start = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["us", "row_id"])
        numbers = []
        for us in rows.us.tolist():
            start = us if n == 0 else start
            n += 1
            numbers.append(seg)
            if n >= size or us - start >= age_us:
                seg, n = seg + 1, 0
        if (rows.type == "session.end").any():
            state.remove()
        else:
            state.update((seg, n, start))
        yield rows.assign(session=key[0], seg=numbers)[["session", "row_id", "us", "type", "seg"]]

    rows = events.select("session", "row_id", "us", "type")
    return rows.groupBy("session").applyInPandasWithState(update, "session string, row_id long, us long, type string, seg long", "seg long, n long, start long", "append", "NoTimeout")


def latest_answers(events: DataFrame) -> DataFrame:
    """Connects with the name that their address was last resolved to, within its time to live; answers outlive it by nothing.

    events: ts, addr, us, row_id, kind ('answer' or 'connect'), qname, ttl_us. Rows of a trigger are taken in time order.
    """
    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["us", "kind", "row_id"])
        for us, kind, row, qname, ttl in zip(rows.us.tolist(), rows.kind, rows.row_id.tolist(), rows.qname, rows.ttl_us):
            if kind == "answer":
                held = (qname, us, us + int(ttl))
            else:
                out.append((row, us, key[0], held[0] if held and us <= held[2] else None))
        if held:
            state.update(held)
            _keep_until(state, held[2])
        yield pd.DataFrame(out, columns=["row_id", "us", "addr", "qname"])

    return events.groupBy("addr").applyInPandasWithState(update, "row_id long, us long, addr string, qname string", "qname string, seen long, until long", "append", "EventTimeTimeout")


def shed(events: DataFrame, rate: float = 20_000, burst: float = 20_000) -> DataFrame:
    """session, row_id, us and shed of events (session, us, row_id, tier, ts), by one tiered bucket a session.

    An idle bucket is full again after ``TIERS * burst / rate`` seconds, and then its state goes.
    """
    full_us = int(TIERS * burst / rate * 1e6)

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = TieredBucket(rate, burst)
        if state.exists:
            bucket.tokens, bucket.last = list(state.get[0]), state.get[1]
        rows = pd.concat(list(batches)).sort_values(["us", "row_id"])
        gone = [not pd.isna(t) and not bucket.admit(int(us), int(t)) for us, t in zip(rows.us, rows.tier)]
        if bucket.last is not None:
            state.update((bucket.tokens, bucket.last))
            _keep_until(state, bucket.last + full_us)
        yield rows.assign(session=key[0], shed=gone)[["session", "row_id", "us", "shed"]]

    rows = events.select("session", "row_id", "us", "tier", "ts")
    return rows.groupBy("session").applyInPandasWithState(update, "session string, row_id long, us long, shed boolean", "tokens array<double>, last long", "append", "EventTimeTimeout")


def append_batches(events: DataFrame, path: str, checkpoint: str):
    """Append sink of a stream, exactly once by the file sink's own log."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What ``transformWithStateInPandas`` keeps its state in; set it as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ClosedSegments(StatefulProcessor):
    """A session's open segment (number, events, first and last time), and a timer for its age.

    A segment holds ``size`` events at most, all less than ``age_us`` after its first. It closes when
    it is full, with an event that is too late for it, when the watermark passes its age without
    one, or at the session's end, which clears the state.
    """

    def __init__(self, size: int, age_us: int):
        self.size, self.age_us = size, age_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seg long, n long, first long, last long")

    def _timer(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    @staticmethod
    def _closed(key, held, why: str) -> tuple:
        seg, n, first, last = held
        return key[0], seg, n, first, last, why

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(rows, columns=["session", "seg", "events", "first_us", "last_us", "closed_by"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seg, n, first, last = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        out, ended = [], False
        for batch in rows:
            ordered = batch.sort_values(["us", "row_id"])
            for us, kind in zip(ordered.us.tolist(), ordered.type):
                if n and us - first >= self.age_us:
                    out.append(self._closed(key, (seg, n, first, last), "age"))
                    seg, n = seg + 1, 0
                first = us if n == 0 else first
                n, last = n + 1, us
                if n >= self.size or kind == "session.end":
                    out.append(self._closed(key, (seg, n, first, last), "end" if kind == "session.end" else "size"))
                    seg, n = seg + 1, 0
                ended = kind == "session.end"
        self._timer()
        if ended:
            self.open.clear()
        else:
            self.open.update((seg, n, first, last))
            if n:
                self.handle.registerTimer((first + self.age_us) // 1000 + 1)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seg, n, first, last = self.open.get()
        self.open.update((seg + 1, 0, 0, 0))
        yield from self._frame([self._closed(key, (seg, n, first, last), "timer")] if n else [])

    def close(self) -> None:
        pass


def closed_segments(events: DataFrame, size: int = 4096, age_us: int = 60_000_000) -> DataFrame:
    """session, seg, events, first_us, last_us and closed_by (size, age, timer, end) of segments as they close. events carry a watermark on ts."""
    rows = events.select("session", "row_id", "us", "type", "ts")
    return rows.groupBy("session").transformWithStateInPandas(ClosedSegments(size, age_us), "session string, seg long, events long, first_us long, last_us long, closed_by string", "Append", "EventTime")


class SessionWatch(StatefulProcessor):
    """All that is remembered of a session under one key, so that its end clears all of it.

    contacts: when each was last seen. bursts: the times inside the window of each class, a list a
    class at most the threshold long. bucket: the load shedder's tokens. An idle session is
    forgotten by a timer, and a contact by its time to live.
    """

    def __init__(self, window_us: int, threshold: int, rate: float, burst: float, idle_us: int):
        self.window_us, self.threshold, self.rate, self.burst, self.idle_us = window_us, threshold, rate, burst, idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.contacts = handle.getMapState("contacts", "contact string", "seen long")
        self.bursts = handle.getMapState("bursts", "class string", "times array<long>, armed boolean")
        self.bucket = handle.getValueState("bucket", "tokens array<double>, last long")

    def _clear(self) -> None:
        for state in (self.contacts, self.bursts, self.bucket):
            state.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def _burst(self, cls: str, us: int) -> bool:
        times, armed = self.bursts.getValue((cls,)) if self.bursts.containsKey((cls,)) else ([], True)
        times = [t for t in times if t > us - self.window_us][max(0, len(times) - self.threshold + 1) :] if self.threshold > 1 else []
        times.append(us)
        full = len(times) >= self.threshold
        self.bursts.updateValue((cls,), (times[-self.threshold :], not full))
        return full and armed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, newest = [], 0
        for batch in rows:
            for r in batch.sort_values(["us", "row_id"]).itertuples():
                us, row = int(r.us), int(r.row_id)
                newest = max(newest, us)
                if r.contact:
                    known = self.contacts.containsKey((r.contact,)) and us - self.contacts.getValue((r.contact,))[0] <= self.idle_us
                    if not known:
                        out.append((key[0], row, us, "first_contact", r.contact))
                    self.contacts.updateValue((r.contact,), (us,))
                if r.burst_class and self._burst(r.burst_class, us):
                    out.append((key[0], row, us, "burst", r.burst_class))
                if not pd.isna(r.tier):
                    bucket = TieredBucket(self.rate, self.burst)
                    if self.bucket.exists():
                        held = self.bucket.get()
                        bucket.tokens, bucket.last = list(held[0]), held[1]
                    if not bucket.admit(us, int(r.tier)):
                        out.append((key[0], row, us, "shed", str(int(r.tier))))
                    self.bucket.update((bucket.tokens, bucket.last))
                if r.type == "session.end":
                    self._clear()
                    newest = 0
        if newest:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max((newest + self.idle_us) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["session", "row_id", "us", "what", "subject"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        yield pd.DataFrame([], columns=["session", "row_id", "us", "what", "subject"])

    def close(self) -> None:
        pass


def session_watch(events: DataFrame, contact: Column, cls: Column, tier: Column, window_us: int, threshold: int, rate: float = 20_000, burst: float = 20_000, idle_us: int = 30 * 86_400_000_000) -> DataFrame:
    """session, row_id, us, what (first_contact, burst, shed) and subject, from one state a session that session.end clears. events carry a watermark on ts."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = events.select("session", "row_id", "us", "type", "ts", text(contact).alias("contact"), text(cls).alias("burst_class"), tier.cast("double").alias("tier"))
    return rows.groupBy("session").transformWithStateInPandas(SessionWatch(window_us, threshold, rate, burst, idle_us), "session string, row_id long, us long, what string, subject string", "Append", "EventTime")
