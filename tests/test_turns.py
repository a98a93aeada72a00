import datetime as dt

import pytest

from scribeval.operators.turns import session_summary, sessionize
from scribeval.streaming.turn_sessions import run_turn_sessions, stage_events

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _events(spark):
    def ev(i, s, kind, eot=None, err=None):
        return (1, i, T0 + dt.timedelta(seconds=s), kind, eot,
                f"t{i}" if kind == "turn" else None, err)
    rows = [ev(1, 0, "turn", False), ev(2, 1, "turn", True), ev(3, 2, "error", err="e3"), ev(4, 3, "turn", True),
            ev(5, 4, "termination"), ev(6, 10, "turn", True), ev(7, 12, "termination"),
            ev(8, 100, "turn", False), ev(9, 131, "turn", False), ev(10, 140, "turn", True), ev(11, 150, "termination"),
            ev(12, 151, "error", err="e12")]
    return spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp, kind string, "
                                       "end_of_turn boolean, transcript string, error string")


def test_batch_sessions(spark):
    s = {r.session_no: r for r in session_summary(sessionize(_events(spark))).collect()}
    assert s[0].text == "t2 t4" and s[0].ttfb == 0.0 and s[0].ttfs == 3.0 and s[0].failure == "e3"
    assert s[1].text == "t6" and s[1].failure is None and s[1].terminated
    assert s[2].failure == "timed out waiting for response" and s[2].ttfs is None
    assert s[3].text == "t10" and s[3].failure is None  # a silence opens a session
    assert s[4].failure == "timed out waiting for response" and s[4].first_error == "e12"  # time-out before error
    assert sorted(s) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n_files", [1, 3, 30])
def test_stream_equals_batch_however_it_is_cut(spark, tmp_path, n_files):
    ev = _events(spark)
    src = stage_events(ev, str(tmp_path / "feed"), n_files=n_files)
    got = [tuple(r) for r in run_turn_sessions(spark, src, max_files_per_trigger=1).collect()]
    want = [tuple(r) for r in session_summary(sessionize(ev)).select(
        *run_turn_sessions(spark, src).columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({r[:2] for r in got}) == len(got)
