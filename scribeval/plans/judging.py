"""Judge-reply (LASER) queries: parsing, shortcut, aggregates, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import judge as J
from ..functions.strings import sql_fmt_fixed
from ..operators.summary import eval_summary
from ..session import materialize
from ..sources import fixtures as fx
from . import oracle as O
from .evaluation import eval_results, joined_samples, results_sql, scored_samples, summary_sql


# --- Spark ----------------------------------------------------------------------

def parsed_replies(spark: SparkSession, sf: str) -> DataFrame:
    return J.with_parsed_reply(fx.judge_replies(spark, sf), "raw", "reply")


def judged_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples, transcriptions and judge replies: the replies join before the
    scoring, where samples and hypotheses already lie by sample_id."""
    return joined_samples(spark, sf).join(fx.judge_replies(spark, sf, for_join=True), "sample_id", "left")


def judged_results(joined: DataFrame) -> DataFrame:
    """Per-sample results with a ``laser`` struct; an invalid judge reply
    fails the sample (it is then skipped, like a failed transcription)."""
    r = J.with_parsed_reply(scored_samples(joined), "raw", "reply")
    sc = J.shortcut(F.col("norm_ref"), F.col("norm_hyp"))
    rp = F.col("reply")
    judged = F.struct(*[rp.getField(k).alias(k) for k in J.LASER_STRUCT])
    needs = F.col("needs_judge")
    r = r.withColumn("_decided", sc).withColumn("needs_judge", F.col("_decided").isNull())
    laser = F.when(~needs, F.col("_decided")).when(F.coalesce(rp.getField("valid"), F.lit(False)), judged)
    err = F.coalesce(F.col("error"), F.when(needs & ~F.coalesce(rp.getField("valid"), F.lit(False)),
                                             F.concat(F.lit("judge: "), F.coalesce(rp.getField("reason"),
                                                                                  F.lit("no reply")))))
    out = r.withColumn("laser", laser).withColumn("error", err).withColumn("laser_score", F.col("laser.laser_score"))
    return out.drop("reply", "raw", "_decided")


def laser_results(spark: SparkSession, sf: str) -> DataFrame:
    """``judged_results`` of a run, written once: summaries read it in several
    branches."""
    return materialize(judged_results(judged_samples(spark, sf)).drop("reference", "text"), "laser_results")


def _ok(df):
    return df.where(F.col("error").isNull())


def json_parse_reply(spark, sf):
    p = parsed_replies(spark, sf)
    r = F.col("reply")
    return p.select(
        "sample_id", r.valid.alias("valid"), r.reason.alias("reason"), r.word_count.alias("word_count"),
        r.total_penalty.alias("total_penalty"), F.round(r.laser_score, 9).alias("laser_score"),
        F.round(r.raw_score, 9).alias("raw_score"),
        *[F.array_join(r.getField(k), "; ").alias(k) for k in J.LIST_FIELDS])


def json_alias_map(spark, sf):
    """Which key supplied the score (canonical or alias) and its value."""
    p = fx.judge_replies(spark, sf).withColumn("_j", F.from_json("raw", J.reply_schema()))
    return p.select("sample_id",
                    F.when(F.col("_j.laser_score").isNotNull(), "laser_score")
                    .when(F.col("_j.score").isNotNull(), "score").alias("score_key"),
                    F.round(F.coalesce(F.col("_j.laser_score"), F.col("_j.score")).try_cast("double"), 9)
                    .alias("raw_score"))


def json_string_to_list(spark, sf):
    p = parsed_replies(spark, sf)
    return p.select("sample_id", *[F.size(F.col("reply").getField(k)).alias(f"n_{k}") for k in J.LIST_FIELDS],
                    *[F.array_join(F.col("reply").getField(k), "; ").alias(k) for k in J.LIST_FIELDS])


def flt_required_fields(spark, sf):
    p = parsed_replies(spark, sf)
    return p.select("sample_id", F.col("reply.valid").alias("valid"), F.col("reply.reason").alias("reason"))


def num_clamp(spark, sf):
    # Written first: the optimizer pushes the filter below the projections and
    # copies the whole reply into it, where each word is looked up in a list
    # that is split anew (a line's cost is then the square of its words).
    p = materialize(parsed_replies(spark, sf).select("sample_id", F.col("reply.raw_score").alias("raw")), "reply_scores")
    p = p.where(F.col("raw").isNotNull())
    return p.select("sample_id", F.round("raw", 9).alias("raw_score"),
                    F.round(J.clamp01(F.col("raw")), 9).alias("laser_score"))


def laser_shortcut(spark, sf):
    r = _ok(eval_results(spark, sf))
    sc = J.shortcut(F.col("norm_ref"), F.col("norm_hyp"))
    return r.select("sample_id", sc.isNull().alias("needs_judge"), sc.word_count.alias("word_count"),
                    sc.laser_score.alias("laser_score"), sc.total_penalty.alias("total_penalty"))


def str_missing_marker(spark, sf):
    r = _ok(eval_results(spark, sf)).where((F.col("norm_ref") != "") & (F.col("norm_hyp") == ""))
    sc = J.shortcut(F.col("norm_ref"), F.col("norm_hyp"))
    return r.select("sample_id", F.get(sc.major_errors, 0).alias("marker"))


def str_judge_prompt(spark, sf):
    """The judge's request of each sample that needs it: both messages, as
    columns and as the JSON text that is sent."""
    r = _ok(eval_results(spark, sf)).where((F.col("norm_ref") != "") & (F.col("norm_hyp") != ""))
    r = r.select("sample_id", F.lit(J.SYSTEM_PROMPT).alias("system_content"), J.user_prompt(F.col("norm_ref"), F.col("norm_hyp")).alias("user_content"))
    return r.withColumn("messages", J.messages(F.col("system_content"), F.col("user_content")))


def q_eval_laser(spark, sf):
    return eval_summary(laser_results(spark, sf), laser=True)


def agg_laser_overall(spark, sf):
    r = _ok(laser_results(spark, sf))
    return r.agg(F.count("laser_score").alias("scored"),
                 F.round((1 - F.avg("laser_score")) * 100, 9).alias("laser_pct"))


def agg_laser_by_dataset(spark, sf):
    r = laser_results(spark, sf).where(F.col("error").isNull() & (F.col("dataset") != ""))
    each = r.groupBy("dataset").agg(
        F.count("*").alias("samples"),
        F.round((1 - F.coalesce(F.sum("laser_score"), F.lit(0.0)) / F.count("*")) * 100, 9).alias("laser_pct"))
    # a breakdown of one dataset says nothing the overall score does not
    return each.withColumn("_n", F.count("*").over(Window.partitionBy())).where("_n > 1").drop("_n")


def agg_error_counts(spark, sf):
    r = _ok(laser_results(spark, sf))
    return r.groupBy("dataset").agg(
        *[F.sum(F.size(F.col("laser").getField(k))).alias(f"n_{k}") for k in J.LIST_FIELDS])


def num_error_pct(spark, sf):
    r = _ok(laser_results(spark, sf))
    return r.select("sample_id", F.round(J.error_pct(F.col("laser_score")), 9).alias("error_pct"))


def str_feedback(spark, sf):
    r = _ok(laser_results(spark, sf))
    L = F.col("laser")
    return r.select("sample_id", J.feedback(L.word_count, L.no_penalty_errors, L.major_errors,
                                           L.minor_errors, L.total_penalty, L.laser_score).alias("feedback"),
                    J.is_perfect(L.major_errors, L.minor_errors).alias("perfect"))


# --- oracle -----------------------------------------------------------------------

def _positions(pred: str) -> str:
    return f"list_filter(list_transform(w, lambda x, i: CASE WHEN {pred} THEN i END), lambda x: x IS NOT NULL)"


def judge_raw_ctes() -> list[str]:
    maj = f"list_transform({_positions('(i - 1) % 11 = 5 AND (i - 1) % 7 <> 3')}, lambda i: '''' || w[i] || ''' -> ''zz''')"
    mnr = f"list_transform({_positions('(i - 1) % 7 = 3')}, lambda i: 'omitted ''' || w[i] || '''')"
    nop = f"list_transform({_positions('(i - 1) % 13 = 6 AND (i - 1) % 7 <> 3')}, lambda i: 'filler ''uh'' after ''' || w[i] || '''')"
    base = "word_count := n, {np} := nopen, {mj} := major, {mn} := minor"
    canon = base.format(np="no_penalty_errors", mj="major_errors", mn="minor_errors")
    alias = base.format(np="non_penalizable_errors", mj="major_penalizable_errors", mn="minor_penalizable_errors")
    return [f"""
jl AS (
  SELECT sample_id, n, {maj} AS major, {mnr} AS minor, {nop} AS nopen
  FROM (SELECT sample_id, w, len(w) AS n FROM (SELECT sample_id, {O.SPLIT_WORDS('text')} AS w FROM utter))
)""", """
jp AS (
  SELECT *, (len(major) + len(minor) * 0.5::DOUBLE)::DOUBLE AS penalty,
         CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - (len(major) + len(minor) * 0.5::DOUBLE) / n END AS score
  FROM jl
)""", f"""
judge AS (
  SELECT sample_id, CAST(CASE
    WHEN sample_id % 41 = 0 THEN NULL
    WHEN sample_id % 5 = 0 THEN to_json(struct_pack({canon}, total_penalty := penalty, laser_score := score))
    WHEN sample_id % 5 = 1 THEN to_json(struct_pack({alias}, total_penalty := penalty, score := score))
    WHEN sample_id % 5 = 2 THEN to_json(struct_pack(word_count := n, no_penalty_errors := '',
         major_errors := CAST(to_json(major) AS VARCHAR), minor_errors := coalesce(minor[1], ''),
         total_penalty := penalty, laser_score := score))
    WHEN sample_id % 5 = 3 THEN to_json(struct_pack({canon}, total_penalty := penalty, laser_score := score * 2 - 0.5::DOUBLE))
    WHEN sample_id % 10 = 4 THEN to_json(struct_pack({canon}, laser_score := score))
    ELSE to_json(struct_pack(word_count := 'many', no_penalty_errors := nopen, major_errors := major,
         minor_errors := minor, total_penalty := penalty, laser_score := score))
  END AS VARCHAR) AS raw
  FROM jp
)"""]


def _jfield(canon: str) -> str:
    keys = (canon,) + J.FIELD_ALIASES[canon]
    return "coalesce(" + ", ".join(f"json_extract_string(raw, '$.{k}')" for k in keys) + ")"


def _as_list_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN json_valid({v}) AND json_type({v}) = 'ARRAY' "
            f"THEN from_json({v}, '[\"VARCHAR\"]') WHEN {v} = '' THEN []::VARCHAR[] ELSE [{v}] END")


def parsed_ctes() -> list[str]:
    lists = ", ".join(f"{_as_list_sql(_jfield(k))} AS {k}" for k in J.LIST_FIELDS)
    return judge_raw_ctes() + [f"""
jparse AS (
  SELECT sample_id, raw, TRY_CAST({_jfield('word_count')} AS INTEGER) AS word_count, {lists},
         TRY_CAST({_jfield('total_penalty')} AS DOUBLE) AS total_penalty,
         TRY_CAST({_jfield('laser_score')} AS DOUBLE) AS raw_score
  FROM judge
)""", """
replies AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw_score)) AS laser_score,
         CASE WHEN raw IS NULL THEN 'empty content'
              WHEN word_count IS NULL OR total_penalty IS NULL OR raw_score IS NULL OR no_penalty_errors IS NULL
                   OR major_errors IS NULL OR minor_errors IS NULL THEN 'missing or invalid field' END AS reason
  FROM jparse
)"""]


def _judge_only(*tail: str) -> str:
    return O.with_recursive(O.utterances_cte(), *parsed_ctes(), *tail)


def sql_json_parse_reply():
    lists = ", ".join(f"array_to_string({k}, '; ') AS {k}" for k in J.LIST_FIELDS)
    return _judge_only() + f""" SELECT sample_id, reason IS NULL AS valid, reason, word_count, total_penalty,
round(laser_score, 9) AS laser_score, round(raw_score, 9) AS raw_score, {lists} FROM replies"""


def sql_json_alias_map():
    return _judge_only() + """ SELECT sample_id,
CASE WHEN json_extract_string(raw, '$.laser_score') IS NOT NULL THEN 'laser_score'
     WHEN json_extract_string(raw, '$.score') IS NOT NULL THEN 'score' END AS score_key,
round(raw_score, 9) AS raw_score FROM replies"""


def sql_json_string_to_list():
    n = ", ".join(f"len({k}) AS n_{k}" for k in J.LIST_FIELDS)
    s = ", ".join(f"array_to_string({k}, '; ') AS {k}" for k in J.LIST_FIELDS)
    return _judge_only() + f" SELECT sample_id, {n}, {s} FROM replies"


def sql_flt_required_fields():
    return _judge_only() + " SELECT sample_id, reason IS NULL AS valid, reason FROM replies"


def sql_num_clamp():
    return _judge_only() + """ SELECT sample_id, round(raw_score, 9) AS raw_score, round(laser_score, 9) AS laser_score
FROM replies WHERE raw_score IS NOT NULL"""


def _laser_ctes() -> list[str]:
    wc = "len(list_filter(string_split(norm_ref, ' '), lambda x: x <> ''))"
    return results_sql() + parsed_ctes() + [f"""
lres AS (
  SELECT r.*, r.norm_ref = '' OR r.norm_hyp = '' AS decided, p.reason AS jreason,
    CASE WHEN r.norm_ref = '' THEN 0 WHEN r.norm_hyp = '' THEN {wc} ELSE p.word_count END AS l_word_count,
    CASE WHEN r.norm_ref = '' THEN []::VARCHAR[] WHEN r.norm_hyp = '' THEN []::VARCHAR[] ELSE p.no_penalty_errors END AS l_no_penalty_errors,
    CASE WHEN r.norm_ref = '' THEN []::VARCHAR[] WHEN r.norm_hyp = ''
         THEN ['entire sentence missing (' || CAST({wc} AS VARCHAR) || ' words)'] ELSE p.major_errors END AS l_major_errors,
    CASE WHEN r.norm_ref = '' THEN []::VARCHAR[] WHEN r.norm_hyp = '' THEN []::VARCHAR[] ELSE p.minor_errors END AS l_minor_errors,
    CASE WHEN r.norm_ref = '' THEN 0.0::DOUBLE WHEN r.norm_hyp = '' THEN CAST({wc} AS DOUBLE) ELSE p.total_penalty END AS l_total_penalty,
    CASE WHEN r.norm_ref = '' THEN 1.0::DOUBLE WHEN r.norm_hyp = '' THEN 0.0::DOUBLE ELSE p.laser_score END AS l_laser_score
  FROM results r LEFT JOIN replies p USING (sample_id)
)""", """
lasered AS (
  SELECT * EXCLUDE (error, l_laser_score), l_laser_score AS laser_score,
    coalesce(error, CASE WHEN NOT decided AND jreason IS NOT NULL THEN 'judge: ' || jreason
                         WHEN NOT decided AND l_word_count IS NULL AND jreason IS NULL THEN 'judge: no reply' END) AS error
  FROM lres
)"""]


def _laser(*tail: str) -> str:
    return O.with_recursive(*_laser_ctes(), *tail)


def sql_laser_shortcut():
    return _laser() + """ SELECT sample_id, NOT decided AS needs_judge,
CASE WHEN decided THEN l_word_count END AS word_count, CASE WHEN decided THEN l_laser_score END AS laser_score,
CASE WHEN decided THEN l_total_penalty END AS total_penalty FROM lres WHERE error IS NULL"""


def sql_str_missing_marker():
    return _laser() + """ SELECT sample_id, l_major_errors[1] AS marker FROM lres
WHERE error IS NULL AND norm_ref <> '' AND norm_hyp = ''"""


def sql_str_judge_prompt():
    system = J.SYSTEM_PROMPT.replace("'", "''")
    return O.with_recursive(*results_sql()) + f""" SELECT *, CAST(to_json([struct_pack("role" := 'system', content := system_content),
struct_pack("role" := 'user', content := user_content)]) AS VARCHAR) AS messages FROM (SELECT sample_id, '{system}' AS system_content,
'Reference: ' || norm_ref || chr(10) || 'Hypothesis: ' || norm_hyp AS user_content FROM results
WHERE error IS NULL AND norm_ref <> '' AND norm_hyp <> '')"""


def sql_q_eval_laser():
    return _laser() + summary_sql("lasered", laser=True)


def sql_agg_laser_overall():
    return _laser() + """ SELECT count(laser_score) AS scored, round((1 - avg(laser_score)) * 100, 9) AS laser_pct
FROM lasered WHERE error IS NULL"""


def sql_agg_laser_by_dataset():
    return _laser() + """ SELECT dataset, count(*) AS samples,
round((1 - coalesce(sum(laser_score), 0.0) / count(*)) * 100, 9) AS laser_pct
FROM lasered WHERE error IS NULL AND dataset <> '' GROUP BY dataset QUALIFY count(*) OVER () > 1"""


def sql_agg_error_counts():
    s = ", ".join(f"sum(len(l_{k})) AS n_{k}" for k in J.LIST_FIELDS)
    return _laser() + f" SELECT dataset, {s} FROM lasered WHERE error IS NULL GROUP BY dataset"


def sql_num_error_pct():
    return _laser() + " SELECT sample_id, round((1.0 - laser_score) * 100, 9) AS error_pct FROM lasered WHERE error IS NULL"


def sql_str_feedback():
    def part(template, col):
        head, tail = template.split("{n}")
        mid, end = tail.split("{errors}")
        q = lambda s: "'" + s.replace("'", "''") + "'"
        return (f"CASE WHEN len({col}) > 0 THEN {q(head)} || CAST(len({col}) AS VARCHAR) || {q(mid)} || "
                f"array_to_string({col}, '; ') || {q(end)} END")
    score = (f"'Score: ' || {sql_fmt_fixed('laser_score', 3)} || ' (' || CAST(l_total_penalty AS VARCHAR) || '/' "
             f"|| CAST(l_word_count AS VARCHAR) || ' word penalties)'")
    perfect = f"CASE WHEN len(l_major_errors) = 0 AND len(l_minor_errors) = 0 THEN '{J.FEEDBACK_PERFECT}' END"
    return _laser() + f""" SELECT sample_id, concat_ws(chr(10), {part(J.FEEDBACK_MAJOR, 'l_major_errors')},
{part(J.FEEDBACK_MINOR, 'l_minor_errors')}, {part(J.FEEDBACK_NOPEN, 'l_no_penalty_errors')}, {score}, {perfect}) AS feedback,
len(l_major_errors) = 0 AND len(l_minor_errors) = 0 AS perfect FROM lasered WHERE error IS NULL"""


QUERIES = {
    "json_parse_reply": json_parse_reply, "json_alias_map": json_alias_map,
    "json_string_to_list": json_string_to_list, "flt_required_fields": flt_required_fields,
    "num_clamp": num_clamp, "laser_shortcut": laser_shortcut, "str_missing_marker": str_missing_marker,
    "str_judge_prompt": str_judge_prompt, "q_eval_laser": q_eval_laser, "agg_laser_overall": agg_laser_overall,
    "agg_laser_by_dataset": agg_laser_by_dataset, "agg_error_counts": agg_error_counts,
    "num_error_pct": num_error_pct, "str_feedback": str_feedback,
}
ORACLE = {k: globals()["sql_" + k] for k in QUERIES}
