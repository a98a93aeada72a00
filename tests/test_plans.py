"""Physical-plan checks: the hot paths stay in the JVM, scans are pruned,
nothing pairs rows by a Cartesian product."""

from pyspark.sql import functions as F

from scribeval.operators.scoring import score_wer
from scribeval.operators.selection import scorable
from scribeval.plans.optimize import candidate_scores
from scribeval.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_is_jvm_only_and_pruned(spark):
    s = scorable(fx.samples(spark, SF)).repartition(8, "sample_id")
    j = s.join(fx.hypotheses(spark, SF), "sample_id")
    p = _plan(score_wer(j).select("sample_id", "wer"))
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # the documents scan reads only what the plan needs (no n_chars, lang or source)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p and "n_chars" not in p


def test_candidate_pairs_without_cartesian_product(spark):
    p = _plan(candidate_scores(spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filter_pushed_to_scan(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("source") == "src1").select("doc_id")
    p = _plan(d)
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in p


def test_maps_and_filters_do_not_shuffle(spark):
    from scribeval.plans import corpus, tools
    for q in (corpus.flt_ignore_marker, corpus.flt_inaudible, corpus.flt_error_triage,
              corpus.prj_route_model, corpus.str_word_count, corpus.str_latency_line, tools.top_line_hits):
        assert "Exchange" not in _plan(q(spark, SF)), q.__name__
