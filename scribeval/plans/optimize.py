"""Prompt leaderboard: candidates scored on the held-out split.

The search over prompts itself (a reflective optimiser driven by a language
model) is an outside service; its candidate prompts and per-sample scores
enter as rows.  Candidates are few and fixed per round, so every validation
sample is paired with every candidate by exploding the candidate ids on the
sample row and joining the prompt text from a broadcast table whose size is
the number of candidates (no cross join, no shuffle of the samples for it).

Scores stand in for the judge: the first four hex digits of
``md5(candidate_id '#' sample_id) / 65535`` (identical in any SQL engine).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import one_row_join, shuffle_split, train_split
from ..operators.selection import scorable
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources.tables import read_events

# --- fixed values ---------------------------------------------------------------
STARTING_PROMPT = "Transcribe verbatim."
CANDIDATE_PROMPTS = (
    STARTING_PROMPT,
    "Transcribe verbatim, keeping every filler word.",
    "Transcribe exactly as spoken and write numbers as digits.",
    "Produce a clean verbatim transcript and keep proper nouns as spoken.",
    "Transcribe verbatim and mark unclear speech as [inaudible].",
)
MINIBATCH = 100
METRIC = "LASER"
OPTIMIZER = "DSPy-GEPA"
MODEL = "batch-v3"
NUM_TRIALS = 50
JUDGE = "judge-v1"
# ---------------------------------------------------------------------------------


def candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CANDIDATE_PROMPTS)), "candidate_id int, prompt string")


def split_samples(spark: SparkSession, sf: str, ranked: bool = False) -> DataFrame:
    """The scorable samples with their split; ``ranked``: numbered as well."""
    s = scorable(fx.samples(spark, sf)).select("sample_id", "dataset")
    return shuffle_split(s) if ranked else train_split(s)


def candidate_scores(spark: SparkSession, sf: str, split: str = "val", ranked: bool = False) -> DataFrame:
    rank = ["shuffle_rank"] if ranked else []
    s = split_samples(spark, sf, ranked).where(F.col("split") == split).select("sample_id", *rank)
    ids = F.array(*[F.lit(i) for i in range(len(CANDIDATE_PROMPTS))])
    pairs = s.select("sample_id", *rank, F.explode(ids).alias("candidate_id"))
    key = F.concat(F.col("candidate_id").cast("string"), F.lit("#"), F.col("sample_id").cast("string"))
    score = F.conv(F.substr(F.md5(key), F.lit(1), F.lit(4)), 16, 10).cast("double") / F.lit(65535.0)
    # the candidate table has one row per prompt: broadcast by construction
    return pairs.join(F.broadcast(candidates(spark)), "candidate_id").withColumn("score", score)


def join_candidate_cross(spark, sf):
    c = candidate_scores(spark, sf)
    return c.select("candidate_id", "sample_id", "prompt", F.round("score", 9).alias("score"))


def _per_candidate(spark, sf):
    c = candidate_scores(spark, sf)
    return c.groupBy("candidate_id", "prompt").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"))


def agg_candidate_scores(spark, sf):
    p = _per_candidate(spark, sf)
    return p.select("candidate_id", "n", F.round("avg_score", 9).alias("avg_score"))


def win_best_candidate(spark, sf):
    p = _per_candidate(spark, sf)
    best = p.agg(F.max_by(F.struct("candidate_id", "prompt", "avg_score"),
                          F.struct("avg_score", (-F.col("candidate_id")).alias("neg_id"))).alias("b"))
    return best.select("b.candidate_id", "b.prompt", F.round("b.avg_score", 9).alias("avg_score"))


def _baseline_final(spark, sf):
    p = _per_candidate(spark, sf)
    agg = p.agg(
        F.max(F.when(F.col("candidate_id") == 0, F.col("avg_score"))).alias("baseline_score"),
        F.max_by(F.struct("candidate_id", "prompt", "avg_score"),
                 F.struct("avg_score", (-F.col("candidate_id")).alias("neg_id"))).alias("b"),
        F.max("n").alias("val_samples"),
    )
    base = F.coalesce(F.col("baseline_score"), F.lit(0.0))
    best = F.coalesce(F.col("b.avg_score"), F.lit(0.0))
    return agg.select(
        F.round(base, 9).alias("baseline_score"), F.round(best, 9).alias("best_score"),
        F.col("b.prompt").alias("best_prompt"), F.col("b.candidate_id").alias("best_candidate"),
        F.round((1 - base) * 100, 9).alias("baseline_err"), F.round((1 - best) * 100, 9).alias("best_err"),
        F.round((1 - base) * 100 - (1 - best) * 100, 9).alias("improvement"),
        F.coalesce(F.col("val_samples"), F.lit(0)).alias("val_samples"))


def agg_baseline_final(spark, sf):
    return _baseline_final(spark, sf)


def flt_skip_perfect(spark, sf):
    """Training samples the seed prompt did not score perfectly."""
    c = candidate_scores(spark, sf, split="train").where(F.col("candidate_id") == 0)
    return c.where(F.col("score") < 1.0).select("sample_id", F.round("score", 9).alias("score"))


def lim_minibatch(spark, sf):
    """Reflection minibatch: the first min(train, 100) non-perfect training
    samples in shuffled order."""
    c = candidate_scores(spark, sf, split="train", ranked=True).where((F.col("candidate_id") == 0) & (F.col("score") < 1.0))
    return c.orderBy("shuffle_rank").limit(MINIBATCH).select("sample_id", "shuffle_rank")


def set_first_seen(spark, sf):
    c = candidate_scores(spark, sf)
    return c.groupBy("prompt").agg(F.min("candidate_id").alias("first_candidate"), F.count("*").alias("n_evals"))


def q_optimize_leaderboard(spark, sf):
    p = _per_candidate(spark, sf)
    base = p.where(F.col("candidate_id") == 0).select(F.col("avg_score").alias("_base"))
    # one row per candidate and one seed row: both tables are tiny by construction
    j = one_row_join(p, base)
    w = Window.orderBy(F.desc("avg_score"), "candidate_id")
    r = j.withColumn("rank", F.row_number().over(w))
    return r.select("candidate_id", "prompt", "n", F.round("avg_score", 9).alias("avg_score"),
                    F.round((1 - F.col("avg_score")) * 100, 9).alias("error_pct"), "rank",
                    (F.col("rank") == 1).alias("is_best"), (F.col("candidate_id") == 0).alias("is_seed"),
                    F.round((1 - F.col("_base")) * 100 - (1 - F.col("avg_score")) * 100, 9).alias("improvement"))


def result_record(spark, sf) -> DataFrame:
    """One row about the run; its time is the newest event's."""
    bf = _baseline_final(spark, sf)
    n = scorable(fx.samples(spark, sf)).agg(F.count("*").alias("total_eval_samples"),
                                            F.array_sort(F.collect_set("dataset")).alias("datasets"))
    at = read_events(spark, sf).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"))
    return one_row_join(one_row_join(bf, n), at).select(
        "best_prompt", F.col("best_score"), F.lit(METRIC).alias("metric"),
        F.lit(STARTING_PROMPT).alias("starting_prompt"), F.lit(MODEL).alias("model"),
        "total_eval_samples", F.lit(OPTIMIZER).alias("optimizer"), F.lit(NUM_TRIALS).alias("num_trials"),
        F.lit(JUDGE).alias("llm_model"), "timestamp", "datasets")


def snk_result_json(spark, sf):
    """Write the run record as JSON (one object per line) and read it back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/result_json/{uuid.uuid4().hex}"
    rec = result_record(spark, sf)
    rec.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema(rec.schema).json(path)


# --- oracle ----------------------------------------------------------------------------

def _cands_sql():
    rows = " UNION ALL ".join(f"SELECT {i} AS candidate_id, '{p.replace(chr(39), chr(39) * 2)}' AS prompt"
                              for i, p in enumerate(CANDIDATE_PROMPTS))
    return f"cands AS ({rows})"


def _opt(tail: str, split: str = "val") -> str:
    from . import corpus
    from . import oracle as O
    return O.with_recursive(O.utterances_cte(), O.samples_cte(), O.hypotheses_cte(), corpus._split_sql(),
                            _cands_sql(), f"""
pairs AS (
  SELECT s.sample_id, s.shuffle_rank, c.candidate_id, c.prompt,
         CAST(('0x' || substr(md5(CAST(c.candidate_id AS VARCHAR) || '#' || CAST(s.sample_id AS VARCHAR)), 1, 4)) AS INTEGER)
           / 65535.0::DOUBLE AS score
  FROM split s CROSS JOIN cands c WHERE s.split = '{split}'
),
per AS (SELECT candidate_id, prompt, count(*) AS n, avg(score) AS avg_score FROM pairs GROUP BY candidate_id, prompt)""") + tail


def sql_join_candidate_cross():
    return _opt(" SELECT CAST(candidate_id AS INTEGER) AS candidate_id, sample_id, prompt, round(score, 9) AS score FROM pairs")


def sql_agg_candidate_scores():
    return _opt(" SELECT CAST(candidate_id AS INTEGER) AS candidate_id, n, round(avg_score, 9) AS avg_score FROM per")


def sql_win_best_candidate():
    return _opt(""" SELECT CAST(candidate_id AS INTEGER) AS candidate_id, prompt, round(avg_score, 9) AS avg_score
FROM per ORDER BY avg_score DESC, candidate_id LIMIT 1""")


BF = """
bf AS (
  SELECT coalesce(max(avg_score) FILTER (WHERE candidate_id = 0), 0.0) AS base,
         coalesce(arg_max(avg_score, (avg_score, -candidate_id)), 0.0) AS best,
         arg_max(prompt, (avg_score, -candidate_id)) AS best_prompt,
         CAST(arg_max(candidate_id, (avg_score, -candidate_id)) AS INTEGER) AS best_candidate,
         coalesce(max(n), 0) AS val_samples
  FROM per
)"""


def sql_agg_baseline_final():
    return _opt(", " + BF + """ SELECT round(base, 9) AS baseline_score, round(best, 9) AS best_score, best_prompt, best_candidate,
round((1 - base) * 100, 9) AS baseline_err, round((1 - best) * 100, 9) AS best_err,
round((1 - base) * 100 - (1 - best) * 100, 9) AS improvement, val_samples FROM bf""")


def sql_flt_skip_perfect():
    return _opt(" SELECT sample_id, round(score, 9) AS score FROM pairs WHERE candidate_id = 0 AND score < 1.0", "train")


def sql_lim_minibatch():
    return _opt(f""" SELECT sample_id, shuffle_rank FROM pairs WHERE candidate_id = 0 AND score < 1.0
ORDER BY shuffle_rank LIMIT {MINIBATCH}""", "train")


def sql_set_first_seen():
    return _opt(" SELECT prompt, CAST(min(candidate_id) AS INTEGER) AS first_candidate, count(*) AS n_evals FROM pairs GROUP BY prompt")


def sql_q_optimize_leaderboard():
    return _opt(""" SELECT CAST(candidate_id AS INTEGER) AS candidate_id, prompt, n, round(avg_score, 9) AS avg_score,
round((1 - avg_score) * 100, 9) AS error_pct, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_best, candidate_id = 0 AS is_seed,
round((1 - base) * 100 - (1 - avg_score) * 100, 9) AS improvement
FROM (SELECT *, row_number() OVER (ORDER BY avg_score DESC, candidate_id) AS rank,
             max(avg_score) FILTER (WHERE candidate_id = 0) OVER () AS base FROM per)""")


def sql_snk_result_json():
    from . import oracle as O
    return _opt(", " + BF + f""" SELECT best_prompt, round(best, 9) AS best_score, '{METRIC}' AS metric,
'{STARTING_PROMPT}' AS starting_prompt, '{MODEL}' AS model,
(SELECT count(*) FROM samples WHERE {O.not_unscorable('reference')}) AS total_eval_samples,
'{OPTIMIZER}' AS optimizer, {NUM_TRIALS} AS num_trials, '{JUDGE}' AS llm_model,
(SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00') FROM events) AS timestamp,
(SELECT list_sort(list(DISTINCT dataset)) FROM samples WHERE {O.not_unscorable('reference')}) AS datasets FROM bf""")


_KEYS = ("join_candidate_cross", "agg_candidate_scores", "win_best_candidate", "agg_baseline_final",
         "flt_skip_perfect", "lim_minibatch", "set_first_seen", "q_optimize_leaderboard", "snk_result_json")
QUERIES = {k: globals()[k] for k in _KEYS}
ORACLE = {k: globals()["sql_" + k] for k in _KEYS}
