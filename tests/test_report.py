import json
import os

from scribeval.plans import extras as X
from scribeval.session import checkpoint_dir

COLUMNS = "sample_id long, dataset string, lang string, reference string, model string, text string, ttfb double, ttfs double, error string, raw string"
TEXTS = {"reference", "text", "norm_ref", "norm_hyp", "laser", "line"}


def _joined(spark):
    reply = json.dumps({"word_count": 2, "no_penalty_errors": [], "major_errors": ["'b' -> 'c'"], "minor_errors": [], "total_penalty": 1.0, "laser_score": 0.5})
    rows = [(7, "d2", "en", "a b", "m", "a c", 0.5, 1.0, None, reply), (-3, "d1", "en", "one day", "m", "one day", None, 2.0, None, reply),
            (7, "d2", "en", "a b", "m", "a b", 0.5, 1.0, None, reply), (9, "d1", "en", "x y", "m", None, None, None, "server error 500", None),
            (8, "d1", "en", "gone", "m", "", None, 3.0, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3, "sample_id")


def _tables(spark):
    return {d for d, _, files in os.walk(checkpoint_dir(spark).removeprefix("file:")) if any(f.endswith(".parquet") for f in files)}


def test_texts_are_written_once(spark, tmp_path):
    before = _tables(spark)
    X.report_lines(_joined(spark), path := str(tmp_path / "report")).collect()
    with_texts = [d for d in _tables(spark) - before if TEXTS & set(spark.read.parquet(d).columns)]
    assert not with_texts and "line" in spark.read.parquet(path).columns


def test_the_query_keeps_no_other_table_of_texts(spark, tmp_path):
    for name, columns, rows in (("documents", "doc_id long, text string, lang string, source string, n_chars long", [(k, f"line {k}\nsecond line {k}", "en", "s", 0) for k in range(9)]),
                                ("benchmark", "item_id long, text string", [(k, f"item {k}") for k in range(3)])):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = _tables(spark)
    assert X.snk_report(spark, str(tmp_path)).where("kind = 'ref'").count()
    assert len([d for d in _tables(spark) - before if TEXTS & set(spark.read.parquet(d).columns)]) == 1


def test_report_numbers_every_row_once(spark, tmp_path):
    rows = X.report_lines(_joined(spark), str(tmp_path / "report")).collect()
    assert sorted((r.i, r.line) for r in rows if r.part == 0 and r.i not in (2, 3)) == [
        (1, "[1/5] (d1) WER: 0.0% | LASER: 50.0% | TTFS 2.00s"), (4, "[4/5] (d1) WER: 100.0% | LASER: 100.0% | TTFS 3.00s"), (5, "[5/5] skipped — error: server error 500")]
    twice = sorted(r.line.split("] ")[1] for r in rows if r.part == 0 and r.i in (2, 3))
    assert twice == ["(d2) WER: 0.0% | LASER: 50.0% | TTFB 0.50s | TTFS 1.00s", "(d2) WER: 50.0% | LASER: 50.0% | TTFB 0.50s | TTFS 1.00s"]
    # the lines of a row have its number
    for i in (2, 3):
        mine = {r.part: r.line for r in rows if r.i == i}
        assert mine[1] == "  REF: a b" and mine[2] == f"  HYP: a {'b' if ' 0.0%' in mine[0] else 'c'}"
    assert sorted((r.kind, r.dataset or "", r.line) for r in rows if r.i is None) == [
        ("dataset", "d1", "WER (d1): 50.00% | Samples: 2 | LASER: 75.00%"), ("dataset", "d2", "WER (d2): 25.00% | Samples: 2 | LASER: 50.00%"),
        ("laser", "", "LASER: 62.50%"), ("overall", "", f"WER: 37.50% | Model: {X.REPORT_MODEL} ({X.REPORT_MODE}) | Samples: 5"), ("skipped", "", "Skipped 1 sample(s) due to errors."),
        ("ttfb", "", "TTFB: avg 0.50s | P95 0.50s | Min 0.50s | Max 0.50s"), ("ttfs", "", "TTFS: avg 1.75s | P95 2.85s | Min 1.00s | Max 3.00s")]


def test_report_of_nothing(spark, tmp_path):
    assert not X.report_lines(_joined(spark).limit(0), str(tmp_path / "report")).collect()
