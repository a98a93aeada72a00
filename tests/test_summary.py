import numpy as np

from scribeval.operators.summary import eval_summary, exact_percentile


def test_latency_stats_match_numpy(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 0.25]
    df = spark.createDataFrame([("all", v) for v in vals], "k string, v double")
    p = exact_percentile(df, "v", ["k"], 0.95, "p").first().p
    assert abs(p - np.percentile(vals, 95)) < 1e-12
    one = spark.createDataFrame([("all", 1.0)], "k string, v double")
    assert exact_percentile(one, "v", ["k"], 0.95, "p").first().p == 1.0


def _results(spark, rows):
    return spark.createDataFrame(rows, "dataset string, error string, wer double, ttfb double, ttfs double, "
                                       "laser_score double")


def test_summary_levels_and_guards(spark):
    rows = [("ds1", None, 0.0, 1.0, 2.0, 1.0), ("ds1", None, 0.5, None, 3.0, 0.5),
            ("ds2", None, 1.0, 2.0, 4.0, None), ("ds2", "boom", None, None, None, None),
            ("", None, 0.25, 1.5, 1.0, 1.0)]
    out = {(r.level, r.dataset): r for r in eval_summary(_results(spark, rows), laser=True).collect()}
    ov = out[("overall", None)]
    assert ov.attempted == 5 and ov.scored == 4 and ov.skipped == 1
    assert abs(ov.wer_pct - 43.75) < 1e-9
    # overall LASER: mean over rows that have a score (3 of 4 scored rows)
    assert abs(ov.laser_pct_scored - (1 - 2.5 / 3) * 100) < 1e-9
    # per-dataset LASER: missing scores count as 0 over all scored rows
    assert abs(out[("dataset", "ds2")].laser_pct_all - 100.0) < 1e-9
    assert ("dataset", "") not in out and len(out) == 3
    assert ov.ttfb_min == 1.0 and ov.ttfb_max == 2.0


def test_failed_datasets_are_not_broken_out(spark):
    rows = [("ds1", None, 0.0, 1.0, 1.0, None), ("ds2", "boom", None, None, None, None)]
    assert [r.level for r in eval_summary(_results(spark, rows)).collect()] == ["overall"]
    three = rows + [("ds3", None, 0.5, 1.0, 1.0, None)]
    out = eval_summary(_results(spark, three), latency_p=None)
    assert sorted(r.dataset or "" for r in out.collect()) == ["", "ds1", "ds3"] and "ttfb_p95" not in out.columns


def test_single_dataset_has_no_breakdown(spark):
    rows = [("ds1", None, 0.0, 1.0, 1.0, None), ("ds1", None, 1.0, 1.0, 1.0, None)]
    levels = [r.level for r in eval_summary(_results(spark, rows)).collect()]
    assert levels == ["overall"]
