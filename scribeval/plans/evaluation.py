"""Evaluation runs: samples -> filters -> quota -> hypotheses -> WER -> summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import score_wer
from ..operators.selection import even_quota, scorable
from ..operators.summary import eval_summary
from ..session import materialize
from ..sources import fixtures as fx
from ..sources.registry import EVALUATED, registry_frame
from . import oracle as O


def scoring_partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def joined_samples(spark: SparkSession, sf_dir: str, total: int | None = None, dataset: str | None = None) -> DataFrame:
    """Scorable samples with their transcriptions: all samples when ``total``
    is None, else the even quota."""
    s = fx.samples(spark, sf_dir, for_join=True)
    if dataset and dataset != "all":
        s = s.where(F.col("dataset") == dataset)
    s = scorable(s)
    if total is not None:
        chosen = even_quota(s.select("sample_id", "dataset"), total, registry=registry_frame(spark, sf_dir, EVALUATED))
        s = s.join(chosen.select("sample_id"), "sample_id", "left_semi")
    # Samples and hypotheses arrive hash-partitioned on sample_id (see
    # ``fixtures.utterances``), so the join needs no further shuffle and the
    # CPU-bound scoring (regex chain + edit distance) runs on every partition.
    return s.join(fx.hypotheses(spark, sf_dir, for_join=True), "sample_id", "inner")


def scored_samples(joined: DataFrame) -> DataFrame:
    scored = score_wer(joined, "reference", "text")
    return scored.withColumn("wer", F.when(F.col("error").isNull(), F.col("wer")))


def eval_results(spark: SparkSession, sf_dir: str, total: int | None = None,
                 dataset: str | None = None) -> DataFrame:
    """Per-sample results (the rows the tool prints one by one).

    The per-sample results are the run's table: every summary, filter and
    judge step reads them.  Writing them once as a table in the checkpoint
    folder (shared storage) scores each sample exactly once, cuts the
    lineage (a lost executor does not re-run the scoring) and keeps the
    optimizer from copying the normaliser into predicates pushed below it."""
    scored = scored_samples(joined_samples(spark, sf_dir, total, dataset))
    return materialize(scored.drop("reference", "text"), "eval_results")


def q_eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: error and latency of the transcriptions over every scorable
    sample, overall and per dataset."""
    return eval_summary(eval_results(spark, sf_dir))


# --- oracle --------------------------------------------------------------------

def results_sql(where: str = "TRUE") -> list[str]:
    """CTEs ending in ``results(sample_id, dataset, error, wer, ttfb, ttfs, ...)``."""
    return [
        O.utterances_cte(), O.samples_cte(), O.hypotheses_cte(),
        f"""
joined AS (
  SELECT s.sample_id, s.dataset, s.reference, h.text, h.model, h.ttfb, h.ttfs, h.error
  FROM samples s JOIN hyps h ON s.sample_id = h.sample_id
  WHERE {O.not_unscorable('s.reference')} AND ({where})
)""",
        O.normalized_ctes("joined", "normed", "sample_id AS key, dataset, error, ttfb, ttfs, model",
                          "reference", "text"),
        O.edit_distance_ctes("normed", "dists"),
        f"""
results AS (
  SELECT n.key AS sample_id, n.dataset, n.error, n.ttfb, n.ttfs, n.model,
         array_to_string(n.rt, ' ') AS norm_ref, array_to_string(n.ht, ' ') AS norm_hyp,
         len(n.rt) AS ref_words, coalesce(d.dist, greatest(len(n.rt), len(n.ht))) AS edits,
         CASE WHEN n.error IS NULL THEN {O.wer_expr('n.rt', 'n.ht', 'd.dist')} END AS wer
  FROM normed n LEFT JOIN dists d ON n.key = d.key
)""",
    ]


def summary_sql(src: str = "results", laser: bool = False) -> str:
    lat = []
    for c in ("ttfb", "ttfs"):
        v = f"CASE WHEN error IS NULL THEN {c} END"
        lat += [f"round(avg({v}), 9) AS {c}_avg", f"round(quantile_cont({v}, 0.95), 9) AS {c}_p95",
                f"round(min({v}), 9) AS {c}_min", f"round(max({v}), 9) AS {c}_max"]
    laser_cols = ""
    if laser:
        s = "CASE WHEN error IS NULL THEN laser_score END"
        laser_cols = (f", round((1 - avg({s})) * 100, 9) AS laser_pct_scored, "
                      f"round((1 - coalesce(sum({s}), 0.0) / count(*) FILTER (WHERE error IS NULL)) * 100, 9) "
                      f"AS laser_pct_all")
    return f"""
SELECT level, dataset, attempted, scored, skipped, wer_pct, {', '.join(c.split(' AS ')[1] for c in lat)}{
        ', laser_pct_scored, laser_pct_all' if laser else ''}, scored = 0 AS all_failed
FROM (
  SELECT *, count(*) FILTER (WHERE level = 'dataset') OVER () AS nds
  FROM (
    SELECT CASE WHEN GROUPING(ds) = 1 THEN 'overall' ELSE 'dataset' END AS level, ds AS dataset,
           count(*) AS attempted, count(*) FILTER (WHERE error IS NULL) AS scored,
           count(*) FILTER (WHERE error IS NOT NULL) AS skipped,
           round(avg(CASE WHEN error IS NULL THEN wer END) * 100, 9) AS wer_pct,
           {', '.join(lat)}{laser_cols}
    FROM (SELECT *, CASE WHEN dataset <> '' THEN dataset END AS ds FROM {src})
    GROUP BY GROUPING SETS ((ds), ())
  ) WHERE level = 'overall' OR (dataset IS NOT NULL AND scored > 0)
) WHERE level = 'overall' OR nds > 1"""


def sql_q_eval_run() -> str:
    return O.with_recursive(*results_sql()) + summary_sql()


QUOTA_TOTAL = 1000


def q_eval_run_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation as the tool runs it: an even per-dataset quota of
    scorable samples (1,000 in total), then scoring and the summary."""
    return eval_summary(eval_results(spark, sf_dir, total=QUOTA_TOTAL))


def sql_q_eval_run_quota() -> str:
    from .corpus import _quota_sql
    sel = ("s.sample_id IN (SELECT r.sample_id FROM ranked r JOIN reg USING (dataset) "
           "WHERE r.rn <= reg.quota)")
    parts = results_sql(where=sel)
    parts = parts[:3] + [_quota_sql(QUOTA_TOTAL)] + parts[3:]
    return O.with_recursive(*parts) + summary_sql()
