from pyspark.sql import functions as F

from scribeval.functions.strings import count_occurrences, fmt_fixed, number_line, replace_first
from scribeval.plans import tools as T


def test_text_edit_helpers(spark):
    df = spark.createDataFrame([("a b a b a", "a", "X")], "c string, o string, n string")
    r = df.select(count_occurrences(F.col("c"), F.col("o")).alias("k"),
                  replace_first(F.col("c"), F.col("o"), F.col("n")).alias("f"),
                  number_line(F.lit(0), F.lit("hello")).alias("ln")).first()
    assert r.k == 3 and r.f == "X b a b a" and r.ln == "   1 | hello"
    ov = spark.createDataFrame([("aaa",)], "c string").select(count_occurrences(F.col("c"), F.lit("aa")).alias("k"))
    assert ov.first().k == 1  # non-overlapping, like str.count


def test_fixed_formatting(spark):
    vals = [0.125, 2.5, -1.005, 0.0, 12.3456, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.s for r in df.select(fmt_fixed(F.col("x"), 2).alias("s")).collect()]
    assert got == ["0.13", "2.50", "-1.00", "0.00", "12.35", None]


def test_step_preview_rules(spark):
    head = T.win_head_lines(spark, "/root/testdata/sf0.001").collect()
    assert all(r.more >= 0 for r in head)
    assert all((r.more_label is None) == (r.more == 0) for r in head)
    pr = T.win_context_prune(spark, "/root/testdata/sf0.001").where("pruned").collect()
    assert pr and all(r.kept_text.endswith("\n[pruned]") and len(r.kept_text) == 209 for r in pr)
