"""Streaming-turn sessions as batch jobs.

One session = one streaming call: a speaker's events up to and including a
termination event, or up to a silence: an event more than 30 seconds after the
speaker's last one belongs to a new call.  Per session:

* ``ttfb``: first turn event minus the session start (first event);
* ``ttfs``: **last** final turn (end_of_turn) minus the start; null if none;
* ``text``: final-turn transcripts joined by a blank in arrival order;
* a session without a termination event timed out; of one that ended, the
  first error (by time) is its failure.

Session numbers count the openings before an event.  A speaker's events are
cut into days; neighbours and counts are taken inside a (speaker, day) and
carried over by a table with one row for each of these, so one busy speaker is
spread over as many windows as days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TIMEOUT_MESSAGE = "timed out waiting for response"
TIMEOUT_SECONDS = 30
# -----------------------------------------------------------------------------


def seconds_between(a, b):
    """``b - a`` in seconds (double)."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)


def sessionize(turns: DataFrame) -> DataFrame:
    """Adds ``session_no`` to turn events (session_id, event_id, ts, kind, ...)."""
    key = ["session_id", "_day"]
    t = turns.withColumn("_day", F.floor(F.unix_seconds("ts") / F.lit(86_400)))
    inside = Window.partitionBy(*key).orderBy("ts", "event_id")
    days = Window.partitionBy("session_id").orderBy("_day")
    last = t.groupBy(*key).agg(F.max(F.struct("ts", "event_id", "kind")).alias("_last")).select(
        *key, F.lag("_last").over(days).alias("_before"))
    t = t.join(last, key).withColumn(
        "_prev", F.coalesce(F.lag(F.struct("ts", "event_id", "kind")).over(inside), F.col("_before")))
    silent = seconds_between(F.col("_prev.ts"), F.col("ts")) > TIMEOUT_SECONDS
    opens = F.coalesce((F.col("_prev.kind") == "termination") | silent, F.lit(False)).cast("long")
    t = t.withColumn("_opens", opens)
    earlier = t.groupBy(*key).agg(F.sum("_opens").alias("_n")).select(
        *key, F.coalesce(F.sum("_n").over(days.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    counted = t.withColumn("_here", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.join(earlier, key).withColumn("session_no", F.col("_earlier") + F.col("_here")).drop(
        "_day", "_before", "_prev", "_opens", "_here", "_earlier")


def session_summary(events: DataFrame) -> DataFrame:
    """Per (session_id, session_no): start, counts, text, ttfb, ttfs,
    first error, terminated, failure."""
    order = F.struct("ts", "event_id")
    is_turn = F.col("kind") == "turn"
    is_final = is_turn & F.coalesce(F.col("end_of_turn"), F.lit(False))
    g = events.groupBy("session_id", "session_no").agg(
        F.min("ts").alias("start_ts"),
        F.count("*").alias("n_events"),
        F.min(F.when(is_turn, F.col("ts"))).alias("_first_turn"),
        F.max(F.when(is_final, F.col("ts"))).alias("_last_final"),
        F.count_if(is_final).alias("n_final"),
        F.sort_array(F.collect_list(F.when(is_final, F.struct("ts", "event_id", "transcript")))).alias("_finals"),
        F.min_by("error", F.when(F.col("kind") == "error", order)).alias("first_error"),
        (F.count_if(F.col("kind") == "termination") > 0).alias("terminated"),
    )
    return g.select(
        "session_id", "session_no", "start_ts", "n_events", "n_final",
        F.array_join(F.transform("_finals", lambda x: x.transcript), " ").alias("text"),
        F.round(seconds_between(F.col("start_ts"), F.col("_first_turn")), 6).alias("ttfb"),
        F.round(seconds_between(F.col("start_ts"), F.col("_last_final")), 6).alias("ttfs"),
        "first_error", "terminated",
        F.when(~F.col("terminated"), F.lit(TIMEOUT_MESSAGE)).otherwise(F.col("first_error")).alias("failure"),
    )
