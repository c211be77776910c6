"""Structured Streaming versions of three batch operators.

* ``stream_daily_revenue`` (X1, twin of A7 without the limit): event-time day
  windows with a watermark, append mode — a day is emitted once the watermark
  passes its end, so the newest day(s) stay open.
* ``stream_attendance`` (X2, twin of W7): a list state per employee holds the open
  clock-ins; an OUT closes all of them and emits Completed rows.
* ``stream_code_cooldown`` (X3, twin of W10): the state of a bucket of (phone, purpose)
  keys holds each one's last accepted request time until an event-time timer (watermark
  past last + cooldown) drops it; every request is emitted with ``accepted``.

X2 is a stateful processor run by ``transformWithStateInPandas``, which keeps its
state in RocksDB: the query's session needs the RocksDB state store provider
(``run_to_parquet`` starts its queries with it). There each look at a key's state is a
message and each key a call of its own; X3, with far more keys and so little state, runs by
``applyInPandasWithState`` over buckets of keys, whose state and timer travel with the rows.
By default both decide each event as it arrives, which is exact when a key's events arrive in time order across micro-batches
(within a micro-batch they are sorted). With ``hold_until_watermark=True`` events wait in a
list state until a timer says that the watermark passed them, and are decided in
event-time order, exact for any order within the allowed lateness. State stays small:
open clock-ins of one employee, one timestamp per recently active code key, plus the
events still inside the lateness window; a key without any of these has no state.

NULL keys are keys like any other. An event without a time is never late: it counts as
earlier than all others that are decided with it, as in the batch twins; a clock-out
without a time closes nothing, a code request without one is accepted and starts no cooldown.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from washbay.operators.codes import RESEND_COOLDOWN_SECONDS

_EPOCH = "1970-01-01 00:00:00"
_DAY_US = 86_400_000_000


def _wall_clock_instant(ntz_col: str):
    """TIMESTAMP_NTZ → TIMESTAMP with the same wall clock read as UTC, independent
    of the session time zone (watermarks need TIMESTAMP, not NTZ)."""
    us = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(ntz_col))
    return F.timestamp_micros(us)


# X1
def stream_daily_revenue(bookings: DataFrame, delay: str = "1 day") -> DataFrame:
    ev = bookings.select(_wall_clock_instant("created_at").alias("_t"), "price")
    agg = (ev.withWatermark("_t", delay).groupBy(F.window("_t", "1 day"))
             .agg(F.coalesce(F.sum("price"), F.lit(0)).cast("bigint").alias("revenue"),
                  F.count(F.lit(1)).alias("bookings")))
    day = F.date_from_unix_date((F.unix_micros(F.col("window.start")) / F.lit(_DAY_US)).cast("int"))
    return agg.select(day.alias("day"), "revenue", "bookings")


ATT_OUT = ("attendance_id long, employee_id long, employee_name string, check_in timestamp_ntz, "
           "check_out timestamp_ntz, status string, created_at timestamp_ntz")
_ATT_TYPES = {"attendance_id": "Int64", "employee_id": "Int64", "employee_name": "object", "check_in": "datetime64[us]",
              "check_out": "datetime64[us]", "status": "object", "created_at": "datetime64[us]"}


def _micros(column: pd.Series) -> list:
    """Times as microseconds, None for none."""
    return [None if t is pd.NaT else int(t.value // 1000) for t in pd.to_datetime(column)]


def _whole(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


def _text(column: pd.Series) -> list:
    return [None if pd.isna(x) else str(x) for x in column]


def _by_time(events: list) -> list:
    """(seq, ts, …) in event order, missing times first, ties by seq."""
    return sorted(events, key=lambda e: (e[1] is not None, e[1] or 0, e[0] is not None, e[0] or 0))


class _Waiting(StatefulProcessor):
    """Decides events (seq, ts, …) in event-time order: as they come, or, with ``hold``, once
    the watermark has passed them. Subclasses name the event columns and say what an
    event does (``decide``) and what their state still needs a timer for (``wakes``)."""

    EVENT = "seq long, ts long"

    def __init__(self, hold: bool):
        self.hold = hold

    def init(self, handle) -> None:
        self.handle = handle
        self.wait = handle.getListState("wait", self.EVENT) if self.hold else None

    def handleInputRows(self, key, rows, timerValues):
        events = [e for pdf in rows for e in self.events(pdf)]
        yield self._go(key, events, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._go(key, [], timerValues)

    def _go(self, key, events: list, timers) -> pd.DataFrame:
        passed = timers.getCurrentWatermarkInMs() * 1000 if self.timed else None
        rest = []
        if self.hold:
            events = [*events, *(tuple(e) for e in self.wait.get())]
            rest = [e for e in events if e[1] is not None and e[1] > passed]
            events = [e for e in events if e[1] is None or e[1] <= passed]
            if rest:
                self.wait.put(rest)
            else:
                self.wait.clear()
        out = self.decide(key, _by_time(events), passed)
        if self.timed:
            wanted = {t // 1000 + 1 for t in [*self.wakes(), *([min(e[1] for e in rest)] if rest else [])]}
            have = set(self.handle.listTimers())
            for t in have - wanted:
                self.handle.deleteTimer(t)
            for t in wanted - have:
                self.handle.registerTimer(t)
        return out

    def wakes(self) -> list:
        return []

    def close(self) -> None:
        pass


class Attendance(_Waiting):
    """Open clock-ins of an employee in a list state. ``forget_ms`` (only without ``hold``, by
    processing time): an open clock-in older than that is forgotten (TTL of the state)."""

    EVENT = "seq long, ts long, type string, name string"

    def __init__(self, hold: bool, forget_ms: int | None = None):
        super().__init__(hold)
        self.forget_ms = forget_ms
        self.timed = hold

    def init(self, handle) -> None:
        super().init(handle)
        more = {"ttlDurationMs": self.forget_ms} if self.forget_ms else {}
        self.open = handle.getListState("open", "seq long, ts long, name string", **more)

    def events(self, pdf):
        return zip(_whole(pdf["seq"]), _micros(pdf["ts"]), _text(pdf["type"]), _text(pdf["employee_name"]))

    def decide(self, key, events, passed):
        kept = [tuple(o) for o in self.open.get()] if events else []
        fresh, cleared, done = [], False, []
        for seq, ts, kind, name in events:
            if kind == "IN":
                fresh.append((seq, ts, name))
            elif kind == "OUT" and ts is not None:
                done += [(s, key[0], n, t, ts, "Completed", t) for s, t, n in [*kept, *fresh]]
                cleared, kept, fresh = cleared or bool(kept), [], []
        if cleared:
            self.open.clear()
        if fresh:
            self.open.appendList(fresh)
        out = pd.DataFrame(done, columns=list(_ATT_TYPES))
        for c in ("check_in", "check_out", "created_at"):
            out[c] = pd.to_datetime(out[c].astype("Int64"), unit="us")
        return out.astype(_ATT_TYPES)


# X2
def stream_attendance(events: DataFrame, hold_until_watermark: bool = False, lateness: str = "10 minutes",
                      forget_after_ms: int | None = None) -> DataFrame:
    """``events``: seq, ts, employee_id, employee_name, type (stream). By default an
    OUT closes the open clock-ins as it arrives (exact for in-order arrival per
    employee); with ``hold_until_watermark`` events wait until the watermark
    passes them and are paired in event-time order (exact within ``lateness``).
    ``forget_after_ms``: clock-ins never closed leave the state after that
    processing time (default: they are kept, as their OUT may still come). Such a
    query has timers of its own and so no end: run it with a processing-time trigger."""
    if hold_until_watermark:
        ev = events.withColumn("_t", _wall_clock_instant("ts")).withWatermark("_t", lateness)
        return ev.groupBy("employee_id").transformWithStateInPandas(Attendance(True), ATT_OUT, "append", "EventTime")
    mode = "ProcessingTime" if forget_after_ms else "None"
    return events.groupBy("employee_id").transformWithStateInPandas(Attendance(False, forget_after_ms), ATT_OUT, "append", mode)


KEY_BUCKETS = 4096       # groups that the code keys are dealt into by hash: a call of Python serves all keys of one
_COOLDOWN_STATE = ("phones array<string>, purposes array<string>, lasts array<long>, "
                   "wait_phones array<string>, wait_purposes array<string>, wait_seqs array<long>, wait_times array<long>")


def _cooldown_step(limit: int, hold: bool):
    """Decides the requests of the (phone, purpose) keys of one bucket; ``limit``: microseconds. State: the
    last accepted request time of each recently active key, and the waiting requests with ``hold``. It comes
    and goes with the rows of a batch, as does its timer; missing numbers and times are flagged, so longs stay longs."""
    def step(_, frames, state):
        passed = state.getCurrentWatermarkMs() * 1000
        lasts, events = {}, {}
        if state.exists:
            phones, purposes, times, *waiting = state.get
            lasts = dict(zip(zip(phones, purposes), times))
            for phone, purpose, q, t in zip(*waiting):
                events.setdefault((phone, purpose), []).append((q, t))
        if not state.hasTimedOut:
            for pdf in frames:
                for phone, purpose, q, has_q, t, has_t in zip(*(pdf[c].tolist() for c in ("phone", "purpose", "seq", "has_seq", "us", "has_us"))):
                    key = (phone if isinstance(phone, str) else None, purpose if isinstance(purpose, str) else None)
                    events.setdefault(key, []).append((q if has_q else None, t if has_t else None))
        kept, rest, out = {}, [], []
        for key in {**lasts, **events}:
            last, due = lasts.get(key), events.get(key, [])
            if hold:
                rest += [(*key, *e) for e in due if e[1] is not None and e[1] > passed]
                due = [e for e in due if e[1] is None or e[1] <= passed]
            for q, t in _by_time(due):
                ok = last is None or t is None or t - last >= limit
                if ok and t is not None:
                    last = t
                out.append((q or 0, q is not None, t or 0, t is not None, *key, ok))
            if last is not None and last + limit > passed:        # otherwise any later request is accepted
                kept[key] = last
        if kept or rest:
            state.update(([k[0] for k in kept], [k[1] for k in kept], [*kept.values()], *([r[i] for r in rest] for i in range(4))))
            end = min([*(t + limit for t in kept.values()), *(r[3] for r in rest)])
            # a timer is due once the watermark is above it, an end once the watermark has reached it
            state.setTimeoutTimestamp(max(1, -(-end // 1000) - 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["seq", "has_seq", "us", "has_us", "phone", "purpose", "accepted"])

    return step


# X3
def stream_code_cooldown(requests: DataFrame, cooldown: int = RESEND_COOLDOWN_SECONDS,
                         lateness: str = "10 minutes", hold_until_watermark: bool = False) -> DataFrame:
    """Per (phone, purpose) state = last accepted time, dropped by an event-time
    timer once the watermark passes it + cooldown (then no earlier request can
    matter), so state stays bounded by the keys active within the cooldown plus
    ``lateness``. Requests older than the watermark are late and dropped.

    By default each request is decided when it arrives (exact for in-order
    arrival per key). With ``hold_until_watermark`` requests wait in state until
    the watermark passes them and are decided in event-time order, which is exact
    for any arrival order within ``lateness``; the newest ``lateness`` of requests
    stays undecided until later data moves the watermark."""
    us = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col("ts"))
    flagged = [F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.col("seq").isNotNull().alias("has_seq"),
               F.coalesce(us, F.lit(0)).cast("bigint").alias("us"), us.isNotNull().alias("has_us")]
    bucket = F.pmod(F.xxhash64("phone", "purpose"), F.lit(KEY_BUCKETS)).cast("int").alias("bucket")
    ev = requests.select(bucket, "phone", "purpose", *flagged, _wall_clock_instant("ts").alias("_t")).withWatermark("_t", lateness)
    rows = "seq long, has_seq boolean, us long, has_us boolean, phone string, purpose string, accepted boolean"
    step = _cooldown_step(cooldown * 1_000_000 - 500_000, hold_until_watermark)
    out = ev.groupBy("bucket").applyInPandasWithState(step, rows, _COOLDOWN_STATE, "append", "EventTimeTimeout")
    ts = F.timestamp_add("MICROSECOND", F.col("us"), F.lit(_EPOCH).cast("timestamp_ntz"))
    return out.select(F.when(F.col("has_seq"), F.col("seq")).alias("seq"), F.when(F.col("has_us"), ts).alias("ts"), "phone", "purpose", "accepted")


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_parquet(stream: DataFrame, out_dir: str, checkpoint: str, mode: str = "append"):
    """Drive a stream over everything available now into parquet files; returns the ended
    query. It runs on the RocksDB state store; the session's own setting stays as it was."""
    spark = stream.sparkSession
    given = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out_dir)
                   .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.unset(STATE_STORE) if given is None else spark.conf.set(STATE_STORE, given)
    q.awaitTermination()
    return q


def replay(spark: SparkSession, df: DataFrame, build, name: str, order_col: str = "ts",
           chunks: int = 4) -> DataFrame:
    """Replay a batch table as a file stream through ``build`` and return what the
    sink received. Rows arrive in ``chunks`` consecutive time ranges: each range is
    staged, then the query runs ``availableNow`` on the same checkpoint, so every
    range is one micro-batch and state/watermarks carry over between them. Rows without a
    time come with the first range. All files live in the shared checkpoint folder."""
    from washbay.session import checkpoint_path
    base = checkpoint_path(spark, f"stream-{name}")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    us = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), F.col(order_col))
    lo, hi = df.agg(F.min(us), F.max(us)).first()          # two scalars
    width = max(1, (hi - lo) // chunks + 1) if lo is not None else 1
    tagged = df.withColumn("_chunk", F.coalesce(((us - F.lit(lo or 0)) / F.lit(width)).cast("int"), F.lit(0)))
    for i in range(chunks):
        tagged.filter(F.col("_chunk") == i).drop("_chunk").write.mode("overwrite").parquet(f"{src}/{i:04d}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(src)
        run_to_parquet(build(stream), out, ck)
    return spark.read.parquet(out)
