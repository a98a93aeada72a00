"""Structured Streaming form of the turn-session collector.

Turn events arrive as files (any file source works the same way; Kafka would
only change ``readStream``).  A stateful processor keyed by speaker
(``transformWithState``) keeps the open session and nothing else:

* a typed value holds the session's running figures, a list its final
  transcripts (appended, never read again before the session ends);
* an event-time timer stands 30 s behind the session's last event of its first
  batch; when the watermark passes it, the session is emitted as timed out, or
  the timer moves to 30 s behind what is then the last event (moving it with
  every batch is two calls more for each speaker and batch);
* a termination event, or an event more than 30 s behind the last one, ends
  the session at once: the same rule as the batch form, so the result does not
  depend on how events fall into batches.

A session that ends takes value, list and timer with it, so a silent speaker
has no state at all.  Session numbers are therefore not counted in the stream:
the sink's reader numbers a speaker's sessions by their starts
(``numbered``), without a task that holds one speaker's sessions.

Events behind the watermark are dropped by the engine before the processor
sees them.  Their count is taken from the query's progress, and
``late_events`` lists them from the feed: a batch drops what is not after the
watermark that stood one batch earlier.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranking import range_row_number
from ..operators.turns import TIMEOUT_MESSAGE, TIMEOUT_SECONDS
from ..session import checkpoint_dir
from .replay import stage_feed

EVENT_SCHEMA = ("session_id long, event_id long, ts timestamp, kind string, end_of_turn boolean, "
                "transcript string, error string")
OUT_SCHEMA = ("session_id long, start_us long, first_event long, n_events long, n_final long, text string, "
              "ttfb double, ttfs double, first_error string, terminated boolean, failure string")
OPEN_SCHEMA = ("start_us long, first_event long, first_turn_us long, last_final_us long, last_us long, n_events long, "
               "n_final long, err_us long, err_event long, err string, timer_ms long")
FINAL_SCHEMA = "us long, event_id long, transcript string"
#: Kind of the events that only move the watermark.
HEARTBEAT = "heartbeat"
TIMEOUT_US = TIMEOUT_SECONDS * 1_000_000
#: Events of a staged file.  Every micro-batch starts a Python worker for each
#: task and calls the state for each speaker, so many small ones cost more than
#: their events do.
EVENTS_A_FILE = 1_000_000


@dataclass
class Open:
    """An open session; the fields of OPEN_SCHEMA in order."""
    start_us: int
    first_event: int
    first_turn_us: int | None = None
    last_final_us: int | None = None
    last_us: int = 0
    n_events: int = 0
    n_final: int = 0
    err_us: int | None = None
    err_event: int | None = None
    err: str | None = None
    timer_ms: int | None = None

    def due(self) -> int:
        """When the session times out, in milliseconds."""
        return self.last_us // 1000 + TIMEOUT_SECONDS * 1000

    def fields(self) -> tuple:
        return tuple(self.__dict__.values())


def _seconds(start_us: int, us: int | None) -> float | None:
    return None if us is None else round((us - start_us) / 1e6, 6)


class SessionCollector(StatefulProcessor):
    """Rows in: (session_id, event_id, us, kind, end_of_turn, transcript,
    error, ts); rows out: OUT_SCHEMA."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN_SCHEMA)
        self.finals = handle.getListState("finals", FINAL_SCHEMA)

    def _finished(self, session_id: int, now: Open, finals: list[tuple], terminated: bool) -> Row:
        held = [tuple(f) for f in self.finals.get()] if now.n_final > len(finals) else []
        text = " ".join(t for _, _, t in sorted(held + finals, key=lambda f: f[:2]) if t is not None)
        return Row(session_id=session_id, start_us=now.start_us, first_event=now.first_event, n_events=now.n_events, n_final=now.n_final,
                   text=text, ttfb=_seconds(now.start_us, now.first_turn_us), ttfs=_seconds(now.start_us, now.last_final_us),
                   first_error=now.err, terminated=terminated, failure=now.err if terminated else TIMEOUT_MESSAGE)

    def _forget(self) -> None:
        self.open.clear()
        self.finals.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session_id = key[0]
        held = self.open.get()
        now = None if held is None else Open(*held)
        kept, old_timer = now is not None, now.timer_ms if now else None
        finals: list[tuple] = []  # of this batch, not yet in the state
        for _, event_id, us, kind, end_of_turn, transcript, error, _ in sorted(map(tuple, rows), key=lambda r: (r[2], r[1])):
            if kind == HEARTBEAT:
                continue
            if now is not None and us - now.last_us > TIMEOUT_US:
                yield self._finished(session_id, now, finals, False)
                if kept:
                    self._forget()
                now, finals, kept = None, [], False
            if now is None:
                now = Open(us, event_id, last_us=us)
            now.last_us = max(now.last_us, us)
            now.n_events += 1
            if kind == "turn":
                if now.first_turn_us is None:
                    now.first_turn_us = us
                if end_of_turn:
                    now.last_final_us = us
                    now.n_final += 1
                    finals.append((us, event_id, transcript))
            elif kind == "error":
                if now.err_us is None or (us, event_id) < (now.err_us, now.err_event):
                    now.err_us, now.err_event, now.err = us, event_id, error
            elif kind == "termination":
                yield self._finished(session_id, now, finals, True)
                if kept:
                    self._forget()
                now, finals, kept = None, [], False
        if now is None:
            if old_timer is not None:
                self.handle.deleteTimer(old_timer)
            return
        # a timer that stands too early is moved when it expires
        now.timer_ms = old_timer
        if old_timer is None:
            now.timer_ms = now.due()
            self.handle.registerTimer(now.timer_ms)
        self.open.update(now.fields())
        if finals:
            self.finals.appendList(finals)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.open.get()
        if held is None:
            return
        now = Open(*held)
        due = now.due()
        if due != now.timer_ms and due >= timerValues.getCurrentWatermarkInMs():
            now.timer_ms = due
            self.handle.registerTimer(due)
            self.open.update(now.fields())
            return
        yield self._finished(key[0], now, [], False)
        self._forget()

    def close(self) -> None:
        pass


def numbered(sessions: DataFrame) -> DataFrame:
    """Adds ``session_no``, from 0 by start, to a speaker's sessions."""
    ranked = range_row_number(sessions, ["start_us", "first_event"], "session_id", out="session_no")
    return ranked.withColumn("session_no", F.col("session_no") - 1)


@dataclass
class SessionRun:
    """Sessions emitted by a stream; events it dropped as late; rows of state
    it held at its end; batches that had data."""
    sessions: DataFrame
    dropped: int
    state_rows: int
    batches: int


def collect_sessions(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 4) -> SessionRun:
    """Stream turn-event files from ``source_dir`` through the session
    collector until all available files are processed."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/turn_sessions/{uuid.uuid4().hex}"
    stream = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("recursiveFileLookup", "true").parquet(source_dir))
    rows = stream.withWatermark("ts", f"{TIMEOUT_SECONDS} seconds").select(
        "session_id", "event_id", F.unix_micros("ts").alias("us"), "kind", "end_of_turn", "transcript", "error", "ts")
    sessions = rows.groupBy("session_id").transformWithState(SessionCollector(), OUT_SCHEMA, "Append", "EventTime")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    # timers need ordered scans of the state
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (sessions.writeStream.format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/ckpt").outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(store, before) if before is not None else spark.conf.unset(store)
    q.awaitTermination()
    seen = list(q.recentProgress)
    state = [op for p in seen for op in p["stateOperators"]]
    return SessionRun(spark.read.schema(OUT_SCHEMA).parquet(f"{base}/out"),
                      sum(op["numRowsDroppedByWatermark"] for op in state), state[-1]["numRowsTotal"] if state else 0,
                      sum(p["numInputRows"] > 0 for p in seen))


def run_turn_sessions(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 4) -> DataFrame:
    """The sessions of ``collect_sessions`` with their numbers."""
    out = numbered(collect_sessions(spark, source_dir, max_files_per_trigger).sessions)
    figures = [c for c in out.columns if c not in ("session_id", "session_no", "start_us", "first_event")]
    return out.select("session_id", "session_no", F.timestamp_micros("start_us").alias("start_ts"), *figures)


def late_events(events: DataFrame, batch_col: str = "batch", delay_s: int = TIMEOUT_SECONDS) -> DataFrame:
    """The events of a feed that a stream with this watermark delay drops as
    late, with ``watermark_us``; ``batch_col`` numbers the batch of each event
    without gaps.  The watermark that a batch drops by is the latest event
    before the previous batch, less the delay, in whole milliseconds."""
    latest = events.groupBy(F.col(batch_col).alias("_batch")).agg(F.max(F.unix_micros("ts")).alias("_latest"))
    # one row for each batch
    before = Window.orderBy("_batch").rangeBetween(Window.unboundedPreceding, -2)
    marks = latest.select("_batch", (F.floor(F.max("_latest").over(before) / 1000) * 1000 - delay_s * 1_000_000).alias("watermark_us"))
    return events.join(marks, F.col(batch_col) == F.col("_batch")).where(F.unix_micros("ts") <= F.col("watermark_us")).drop("_batch")


def stage_events(turns: DataFrame, path: str, n_files: int | None = None, slice_col: str | None = None) -> str:
    """Write turn events as ``n_files`` files in the order of time (default:
    as many as keep a file at about EVENTS_A_FILE events), or one file for each
    value of ``slice_col`` (0, 1, ...; ``n_files`` of them), and last a
    heartbeat an hour later, behind which all sessions are closed."""
    cols = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    n_files = n_files or max(4, -(-turns.count() // EVENTS_A_FILE))
    beat = {"session_id": -1, "event_id": -1, "kind": HEARTBEAT}
    return stage_feed(turns.select(*cols, *([slice_col] if slice_col else [])), path, "ts", n_files, beat, "INTERVAL 1 HOUR", slice_col)
