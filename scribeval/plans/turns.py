"""Turn-event session queries (batch twins and the streaming collector)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.turns import TIMEOUT_MESSAGE, seconds_between, session_summary, sessionize
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..streaming.turn_sessions import collect_sessions, late_events, run_turn_sessions, stage_events


def sessions(spark, sf):
    return session_summary(sessionize(fx.turns(spark, sf)))


def agg_turn_latency(spark, sf):
    """Latencies of the sessions that did not fail."""
    return sessions(spark, sf).where(F.col("failure").isNull()).select("session_id", "session_no", "ttfb", "ttfs")


def agg_turn_concat(spark, sf):
    return sessions(spark, sf).select("session_id", "session_no", "n_final", "text")


def agg_first_error(spark, sf):
    return sessions(spark, sf).where(F.col("first_error").isNotNull()).select(
        "session_id", "session_no", "first_error")


def st_error_fail(spark, sf):
    s = sessions(spark, sf)
    return s.select("session_id", "session_no", F.col("failure").isNotNull().alias("failed"), "failure")


def st_timeout(spark, sf):
    s = sessions(spark, sf).where(~F.col("terminated"))
    return s.select("session_id", "session_no", "n_events", "failure")


def dt_elapsed(spark, sf):
    ev = sessionize(fx.turns(spark, sf))
    start = F.min("ts").over(Window.partitionBy("session_id", "session_no"))
    return ev.select("session_id", "event_id", F.round(seconds_between(start, F.col("ts")), 6).alias("elapsed"))


def dt_utc_iso(spark, sf):
    """Run timestamps as UTC ISO-8601 text (one per session start)."""
    s = sessions(spark, sf)
    ts = F.col("start_ts")
    iso = F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")) \
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    return s.select("session_id", "session_no", iso.alias("started_at"))


def st_turn_sessions(spark, sf):
    """Streaming: turn events replayed from time-ordered files through the
    stateful session collector (emits terminated and timed-out sessions).  A
    last event far behind the others closes the sessions still open."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/turn_events/{uuid.uuid4().hex}"
    stage_events(fx.turns(spark, sf), base)
    return run_turn_sessions(spark, base).withColumn("start_us", F.unix_micros("start_ts")).drop("start_ts")


#: The feed of ``st_late_events``: every 97th event arrives 300 seconds late,
#: and the arrivals come in 12 files of equal time.
LATE_EVERY, LATE_US, LATE_FILES = 97, 300_000_000, 12


def st_late_events(spark, sf):
    """Streaming: the events of a feed with stragglers that the session
    collector's watermark drops, one file a batch; ``dropped`` is the count
    that the stream itself reports."""
    arrival = F.unix_micros("ts") + F.when(F.col("event_id") % LATE_EVERY == 0, LATE_US).otherwise(0)
    turns = fx.turns(spark, sf).withColumn("_arrival", arrival)
    lo, hi = turns.agg(F.min("_arrival"), F.max("_arrival")).first()
    batch = F.least(F.floor((F.col("_arrival") - F.lit(lo)) * LATE_FILES / F.lit(max((hi or 0) - (lo or 0), 1))), F.lit(LATE_FILES - 1))
    turns = turns.withColumn("batch", batch.cast("int"))
    base = f"{checkpoint_dir(spark).rstrip('/')}/late_events/{uuid.uuid4().hex}"
    stage_events(turns, base, LATE_FILES, slice_col="batch")
    run = collect_sessions(spark, base, max_files_per_trigger=1)
    return late_events(turns).select("event_id", "session_id", "kind", F.unix_micros("ts").alias("ts_us"), "batch", "watermark_us",
                                     F.lit(run.dropped).cast("long").alias("dropped"))


# --- oracle -------------------------------------------------------------------------

TURNS = """
turns AS (
  SELECT user_id AS session_id, event_id, make_timestamp(epoch_us(ts) // """ + str(fx.TURN_SPEED) + """) AS ts,
         CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'turn' WHEN event_type = 'error' THEN 'error'
              WHEN event_type = 'signup' THEN 'termination' ELSE 'other' END AS kind,
         CASE WHEN event_type IN ('purchase', 'view', 'click') THEN event_type = 'purchase' END AS end_of_turn,
         CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 't' || CAST(event_id AS VARCHAR) END AS transcript,
         CASE WHEN event_type = 'error' THEN 'error ' || CAST(event_id AS VARCHAR) END AS error
  FROM events
),
sess AS (
  SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no
  FROM (SELECT *, CASE WHEN lag(kind) OVER w = 'termination' OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 30000000
               THEN 1 ELSE 0 END AS opens
        FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
),
summ AS (
  SELECT session_id, session_no, min(ts) AS start_ts, count(*) AS n_events,
         count(*) FILTER (WHERE kind = 'turn' AND coalesce(end_of_turn, false)) AS n_final,
         coalesce(string_agg(transcript, ' ' ORDER BY ts, event_id) FILTER (WHERE kind = 'turn' AND coalesce(end_of_turn, false)), '') AS text,
         round((epoch_us(min(ts) FILTER (WHERE kind = 'turn')) - epoch_us(min(ts))) / 1e6, 6) AS ttfb,
         round((epoch_us(max(ts) FILTER (WHERE kind = 'turn' AND coalesce(end_of_turn, false))) - epoch_us(min(ts))) / 1e6, 6) AS ttfs,
         first(error ORDER BY ts, event_id) FILTER (WHERE kind = 'error') AS first_error,
         count(*) FILTER (WHERE kind = 'termination') > 0 AS terminated
  FROM sess GROUP BY session_id, session_no
),
summ2 AS (
  SELECT *, CASE WHEN NOT terminated THEN '""" + TIMEOUT_MESSAGE + """' ELSE first_error END AS failure FROM summ
)"""


def _w(tail):
    return "WITH " + TURNS + tail


def sql_agg_turn_latency():
    return _w(" SELECT session_id, CAST(session_no AS BIGINT) AS session_no, ttfb, ttfs FROM summ2 WHERE failure IS NULL")


def sql_agg_turn_concat():
    return _w(" SELECT session_id, CAST(session_no AS BIGINT) AS session_no, n_final, text FROM summ2")


def sql_agg_first_error():
    return _w(" SELECT session_id, CAST(session_no AS BIGINT) AS session_no, first_error FROM summ2 WHERE first_error IS NOT NULL")


def sql_st_error_fail():
    return _w(" SELECT session_id, CAST(session_no AS BIGINT) AS session_no, failure IS NOT NULL AS failed, failure FROM summ2")


def sql_st_timeout():
    return _w(" SELECT session_id, CAST(session_no AS BIGINT) AS session_no, n_events, failure FROM summ2 WHERE NOT terminated")


def sql_dt_elapsed():
    return _w(""" SELECT session_id, event_id,
round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY session_id, session_no))) / 1e6, 6) AS elapsed FROM sess""")


def sql_dt_utc_iso():
    return _w(""" SELECT session_id, CAST(session_no AS BIGINT) AS session_no,
CASE WHEN microsecond(start_ts) % 1000000 = 0 THEN strftime(start_ts, '%Y-%m-%dT%H:%M:%S+00:00')
     ELSE strftime(start_ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS started_at FROM summ2""")


def sql_st_turn_sessions():
    return _w(""" SELECT session_id, CAST(session_no AS BIGINT) AS session_no, n_events, n_final, text, ttfb, ttfs,
first_error, terminated, failure, epoch_us(start_ts) AS start_us FROM summ2""")


def sql_st_late_events():
    return _w(f""", arr AS (
  SELECT *, epoch_us(ts) AS ts_us, epoch_us(ts) + CASE WHEN event_id % {LATE_EVERY} = 0 THEN {LATE_US} ELSE 0 END AS arrival FROM turns
),
fed AS (
  SELECT arr.*, CAST(least((arrival - lo) * {LATE_FILES} // greatest(hi - lo, 1), {LATE_FILES - 1}) AS INTEGER) AS batch
  FROM arr, (SELECT min(arrival) AS lo, max(arrival) AS hi FROM arr)
),
marks AS (
  SELECT batch, CAST(max(latest) OVER (ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) // 1000 * 1000 - 30000000 AS BIGINT) AS watermark_us
  FROM (SELECT batch, max(ts_us) AS latest FROM fed GROUP BY batch)
)
SELECT event_id, session_id, kind, ts_us, batch, watermark_us, count(*) OVER () AS dropped
FROM fed JOIN marks USING (batch) WHERE ts_us <= watermark_us""")


QUERIES = {k: globals()[k] for k in (
    "agg_turn_latency", "agg_turn_concat", "agg_first_error", "st_error_fail", "st_timeout",
    "dt_elapsed", "dt_utc_iso", "st_turn_sessions", "st_late_events")}
ORACLE = {k: globals()["sql_" + k] for k in QUERIES if "sql_" + k in globals()}
