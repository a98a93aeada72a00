import threading
import time

import pytest

from scribeval.operators.enrich import enrich, in_rounds, ordered


def test_rounds_pauses_and_error_text():
    pauses, calls = [], []

    def flaky(values):
        calls.append(list(values))
        if len(calls) < 3:
            raise RuntimeError("busy")
        return [v * 2 for v in values]

    assert in_rounds([1, 21, 3], flaky, 4, pauses.append) == [(2, None), (42, None), (6, None)]
    assert pauses == [2, 4] and calls == [[1, 21, 3]] * 3


def test_one_bad_value_does_not_take_its_neighbours():
    pauses, calls = [], []

    def scorer(values):
        calls.append(list(values))
        return [1 / v for v in values]

    got = in_rounds([1, 0, 2], scorer, 3, pauses.append)
    assert [r for r, _ in got] == [1, None, 0.5] and got[1][1].startswith("ZeroDivisionError") and got[0][1] is None
    assert pauses == [2, 4] and calls == [[1, 0, 2], [1, 0, 2], [1], [0], [2]]


def test_a_call_that_returns_too_few_fails():
    (result, error), = in_rounds([5], lambda values: [], 1)
    assert result is None and error == "ValueError: 0 results for 1 values"


def test_twelve_slow_calls_take_the_time_of_one():
    at_once, most = 0, 0
    lock = threading.Lock()

    def slow(i):
        nonlocal at_once, most
        with lock:
            at_once += 1
            most = max(most, at_once)
        time.sleep(0.3)
        with lock:
            at_once -= 1
        return i

    begun = time.time()
    assert list(ordered(range(12), slow, 12)) == list(range(12))
    assert time.time() - begun < 0.9 and most == 12


def test_order_and_lookahead_are_kept():
    read, done = [], []

    def items():
        for i in range(20):
            read.append(i)
            yield i

    def work(i):
        time.sleep(0.02 if i % 3 else 0.06)
        done.append(i)
        return i * i

    out = []
    for value in ordered(items(), work, 4):
        out.append(value)
        assert len(read) - len(out) <= 4
    assert out == [i * i for i in range(20)] and done != sorted(done)


def test_enrich_keeps_rows_and_reports_errors(spark):
    df = spark.createDataFrame([(i, f"w{i} x" if i % 7 else None, "keep") for i in range(100)], "id int, t string, n_error string").drop("n_error")
    out = enrich(df, "t", lambda values: [len(s.split()) for s in values], "n", "int", budget=6, in_flight=3, values_a_call=5, sleep=lambda s: None)
    rows = {r.id: r for r in out.collect()}
    assert out.rdd.getNumPartitions() == 2 and len(rows) == 100
    for i, r in rows.items():
        assert (r.n, r.n_error) == (2, None) if i % 7 else (r.n is None and r.n_error.startswith("AttributeError"))


def test_in_flight_stays_within_the_budget(spark):
    with pytest.raises(ValueError, match="in_flight"):
        enrich(spark.range(1), "id", list, "x", "long", budget=2, in_flight=3)
    out = enrich(spark.range(50), "id", lambda values: [v + 1 for v in values], "x", "long", budget=12, in_flight=12)
    assert out.rdd.getNumPartitions() == 1 and sorted(r.x for r in out.collect()) == list(range(1, 51))
