"""Run summaries: error rates, latency statistics and counts, overall and per
dataset, in one grouping-sets aggregation.

Kept semantics:
* summary WER is the mean of per-sample WERs (never total edits / words);
* the per-dataset LASER divides by all rows of the dataset (a missing score
  counts as 0), the overall LASER only by rows that have a score;
* ``attempted`` counts failures too; ``scored`` and ``skipped`` split it;
* per-dataset rows exist only for datasets with scored rows, and only when
  more than one non-empty dataset has any; and untagged ("") rows count in the overall row only;
* latency: avg, P95 (linear interpolation, as numpy), min, max over the
  values that are present.

P95 is exact and found by histogram refinement (``quantile.py``), without a
sort or a window over the values.  It is made only when asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantile import exact_percentile

ROUND = 9


def _latency_aggs(col: str, prefix: str):
    return [
        F.avg(col).alias(f"{prefix}_avg"),
        F.min(col).alias(f"{prefix}_min"),
        F.max(col).alias(f"{prefix}_max"),
    ]


def eval_summary(results: DataFrame, laser: bool = False, latency_p: float | None = 0.95) -> DataFrame:
    """agg_summary_grouping_sets over per-sample results.

    ``results`` columns: dataset, error (null = scored), wer, ttfb, ttfs and,
    with ``laser``, laser_score.  Returns one ``overall`` row and, when more
    than one non-empty dataset has scored rows, one ``dataset`` row for each
    of these.  ``latency_p`` None leaves the percentiles out."""
    ok = F.col("error").isNull()
    aggs = [
        F.count("*").alias("attempted"),
        F.count_if(ok).alias("scored"),
        F.count_if(~ok).alias("skipped"),
        F.round(F.avg(F.when(ok, F.col("wer"))) * 100, ROUND).alias("wer_pct"),
    ]
    for c in ("ttfb", "ttfs"):
        aggs += _latency_aggs(F.when(ok, F.col(c)), c)
    if laser:
        s = F.when(ok, F.col("laser_score"))
        aggs += [
            # overall form: mean over rows that have a score
            F.round((1 - F.avg(s)) * 100, ROUND).alias("laser_pct_scored"),
            # per-dataset form: sum over all scored rows of the dataset
            F.round((1 - F.coalesce(F.sum(s), F.lit(0.0)) / F.count_if(ok)) * 100, ROUND).alias("laser_pct_all"),
        ]
    tagged = results.withColumn("_ds", F.when(F.col("dataset") != "", F.col("dataset")))
    rolled = tagged.rollup("_ds").agg(*aggs, F.grouping_id().alias("_gid"))
    # the rollup also yields a (null) group for untagged rows; keep only real
    # datasets with scored rows and the grand total
    rolled = rolled.where((F.col("_gid") == 1) | (F.col("_ds").isNotNull() & (F.col("scored") > 0)))
    n_ds = F.count_if(F.col("_gid") == 0).over(Window.partitionBy())
    rolled = rolled.withColumn("_nds", n_ds).where((F.col("_gid") == 1) | (F.col("_nds") > 1))
    out = rolled.select(
        F.when(F.col("_gid") == 1, F.lit("overall")).otherwise(F.lit("dataset")).alias("level"),
        F.col("_ds").alias("dataset"),
        *[c for c in rolled.columns if c not in ("_ds", "_gid", "_nds")],
    )
    if latency_p is not None:
        # both metrics and both levels in the same rounds
        vals = tagged.where(ok).select("_ds", F.explode(F.array(
            F.struct(F.lit("ttfb").alias("metric"), F.col("ttfb").alias("v")),
            F.struct(F.lit("ttfs").alias("metric"), F.col("ttfs").alias("v")))).alias("m")).select(
            "_ds", "m.metric", "m.v")
        both = vals.where(F.col("_ds").isNotNull()).select(
            F.lit("dataset").alias("level"), F.col("_ds").alias("dataset"), "metric", "v").unionByName(
            vals.select(F.lit("overall").alias("level"), F.lit(None).cast("string").alias("dataset"), "metric", "v"))
        pct = exact_percentile(both, "v", ["level", "dataset", "metric"], latency_p, "p")
        pct = pct.groupBy("level", "dataset").agg(
            *[F.max(F.when(F.col("metric") == c, F.col("p"))).alias(f"{c}_p95") for c in ("ttfb", "ttfs")])
        pct = pct.select(F.col("level").alias("_pl"), F.col("dataset").alias("_pd"), "ttfb_p95", "ttfs_p95")
        out = out.join(pct, [out["level"] == pct["_pl"], out["dataset"].eqNullSafe(pct["_pd"])],
                       "left").drop("_pl", "_pd")
    lat = [f"{c}_{s}" for c in ("ttfb", "ttfs") for s in ("avg", "p95", "min", "max") if s != "p95" or latency_p is not None]
    out = out.select(*[F.round(c, ROUND).alias(c) if c in lat else F.col(c) for c in out.columns])
    out = out.withColumn("all_failed", F.col("scored") == 0)
    return out
