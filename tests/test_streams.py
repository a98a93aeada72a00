"""Streams against their batch twins: slices, late rows, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scribeval.operators.turns import session_summary, sessionize
from scribeval.streaming import chunk_windows as cw
from scribeval.streaming.turn_sessions import collect_sessions, late_events, numbered, run_turn_sessions, stage_events

T0 = dt.datetime(2024, 1, 1)
EVENTS = "session_id long, event_id long, ts timestamp, kind string, end_of_turn boolean, transcript string, error string"


def _turns(spark, n, speakers, seed):
    r = random.Random(seed)
    at, rows = 0.0, []
    for i in range(n):
        at += r.choice([0.1, 0.5, 3, 9])
        kind = r.choices(["turn", "error", "termination", "other"], [8, 1, 1, 1])[0]
        final = r.random() < 0.5 if kind == "turn" else None
        rows.append((r.randrange(speakers), i, T0 + dt.timedelta(seconds=at), kind, final,
                     r.choice([f"t{i}", None]) if kind == "turn" else None, f"e{i}" if kind == "error" else None))
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("n_files", [1, 3, 30])
def test_sessions_do_not_depend_on_slices(spark, tmp_path, n_files):
    turns = _turns(spark, 600, 9, 4)
    run = collect_sessions(spark, stage_events(turns, str(tmp_path / "feed"), n_files), max_files_per_trigger=1)
    cols = ["session_id", "session_no", "n_events", "n_final", "text", "ttfb", "ttfs", "first_error", "terminated", "failure"]
    got = sorted(map(tuple, numbered(run.sessions).select(*cols).collect()))
    assert got == sorted(map(tuple, session_summary(sessionize(turns)).select(*cols).collect()))
    assert run.dropped == 0 and run.state_rows == 0  # all speakers are silent at the end


def test_one_late_event_is_counted_and_listed(spark, tmp_path):
    def ev(i, s, batch):
        return (1, i, T0 + dt.timedelta(seconds=s), "turn", True, f"t{i}", None, batch)
    # event 5 belongs to second 5 but comes in the fourth batch; event 6 is behind the others, yet in time
    rows = [ev(1, 0, 0), ev(2, 100, 0), ev(3, 200, 1), ev(4, 300, 2), ev(5, 5, 3), ev(7, 310, 3), ev(6, 290, 3)]
    events = spark.createDataFrame(rows, EVENTS + ", batch int")
    run = collect_sessions(spark, stage_events(events, str(tmp_path / "feed"), 4, slice_col="batch"), max_files_per_trigger=1)
    late = late_events(events).collect()
    assert run.dropped == 1 and [(r.event_id, r.batch) for r in late] == [(5, 3)]
    assert run.sessions.agg(F.sum("n_events")).first()[0] == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_late_table_equals_the_streams_count(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(1, i, T0 + dt.timedelta(seconds=i - (r.randint(0, 200) if r.random() < 0.2 else 0)), "turn", True, "t", None, i // 60) for i in range(600)]
    events = spark.createDataFrame(rows, EVENTS + ", batch int")
    run = collect_sessions(spark, stage_events(events, str(tmp_path / "feed"), 10, slice_col="batch"), max_files_per_trigger=1)
    assert 0 < run.dropped == late_events(events).count()


def test_no_events(spark, tmp_path):
    none = spark.createDataFrame([], EVENTS)
    assert run_turn_sessions(spark, stage_events(none, str(tmp_path / "feed"))).count() == 0


def _chunks(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, chunk_no int, n_bytes int, offset_ms int")


@pytest.mark.parametrize("n_files", [1, 4])
def test_chunk_windows_equal_the_batch_form(spark, tmp_path, n_files):
    times = cw.chunk_times(_chunks(spark, [(c, k, 3200 if k < 30 else 100 + c, 20 * k) for c in range(6) for k in range(20 + 4 * c)]))
    run = cw.chunk_windows(spark, cw.stage_chunks(times, str(tmp_path / "feed"), n_files))
    got = sorted(map(tuple, run.windows.collect()))
    assert got == sorted(map(tuple, cw.tumbling(times).collect())) and run.dropped == 0
    assert run.state_rows <= 1  # the heartbeat's window
    first = [r for r in got if r[0] == 0]
    assert [(r[3], r[4]) for r in first] == [(5, 16_000)] * 4


def test_late_chunk_is_dropped_and_counted(spark, tmp_path):
    times = cw.chunk_times(_chunks(spark, [(1, 0, 10, 0), (1, 1, 10, 500), (1, 2, 10, 900), (1, 3, 77, 20), (1, 4, 10, 950)]))
    times = times.withColumn("batch", F.element_at(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3), F.lit(3)), F.col("chunk_no") + 1))
    run = cw.chunk_windows(spark, cw.stage_chunks(times, str(tmp_path / "feed"), 4, slice_col="batch"))
    assert run.dropped == 1 and run.windows.agg(F.sum("n_bytes")).first()[0] == 40


def test_batches_of_slices_do_not_grow_with_the_files(spark, tmp_path):
    from scribeval.streaming import replay
    rows = spark.range(600).select((F.col("id") % 5).cast("int").alias("candidate_id"), F.concat(F.lit("p"), F.col("id") % 5).alias("prompt"), "id")
    path = replay.stage_slices(rows.repartition(20), str(tmp_path / "slices"), "id")
    assert len(spark.read.parquet(path).inputFiles()) > 60
    schema = "prompt string, candidate_id int, id long"
    batches = []
    q = (replay._source(spark, path, schema).writeStream.foreachBatch(lambda d, i: batches.append(d.count()))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(batches) <= 4 and sum(batches) == 600  # before: half as many as files
    assert sorted(map(tuple, replay.prompt_dedup(spark, path, schema).collect())) == [(f"p{i}", i) for i in range(5)]


def test_session_kept_open_over_batches_moves_its_timer(spark, tmp_path):
    # one event every 20 s, a file each: the first timer expires while the session goes on
    rows = [(1, i, T0 + dt.timedelta(seconds=20 * i), "turn", True, f"t{i}", None, i) for i in range(8)]
    rows += [(2, 100 + i, T0 + dt.timedelta(seconds=20 * i), "turn", True, "x", None, i) for i in (0, 4, 7)]
    turns = spark.createDataFrame(rows, EVENTS + ", batch int")
    run = collect_sessions(spark, stage_events(turns, str(tmp_path / "feed"), 8, slice_col="batch"), max_files_per_trigger=1)
    cols = ["session_id", "session_no", "n_events", "n_final", "text", "ttfb", "ttfs", "first_error", "terminated", "failure"]
    got = sorted(map(tuple, numbered(run.sessions).select(*cols).collect()))
    assert got == sorted(map(tuple, session_summary(sessionize(turns)).select(*cols).collect()))
    assert [g[:3] for g in got] == [(1, 0, 8), (2, 0, 1), (2, 1, 1), (2, 2, 1)] and run.state_rows == 0


def test_staged_files_hold_a_million_events(spark, tmp_path, monkeypatch):
    from scribeval.streaming import turn_sessions as ts
    monkeypatch.setattr(ts, "EVENTS_A_FILE", 100)  # before: a fixed figure, and a tenth of it
    path = stage_events(_turns(spark, 650, 5, 2), str(tmp_path / "feed"))
    assert len(spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles()) == 8
