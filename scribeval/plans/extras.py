"""Remaining inventory: selection dispatch, latency guards, audio store,
report lines, streams, Python-side operators (alignment, rubric, enrichment)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import audio as A
from ..functions import judge as J
from ..functions.strings import fmt_fixed, sql_fmt_fixed
from ..operators.align import align_ops
from ..operators.enrich import enrich
from ..operators.ranking import range_row_number
from ..operators.rubric import rubric_scores
from ..operators.sampling import one_row_join, shuffle_split
from ..operators.selection import named_dataset, scorable
from ..operators.summary import eval_summary
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources.registry import EVALUATED, registry_frame
from ..sources.tables import read_table
from ..streaming import replay
from . import oracle as O
from .evaluation import eval_results, results_sql, summary_sql
from .judging import judged_results, judged_samples
from .optimize import candidate_scores
from .tools import win_greedy_windows

SELECTED = "documents-de-train"
REPORT_MODEL = fx.BATCH_MODEL
REPORT_MODE = "batch"


# --- selection ---------------------------------------------------------------------

def load_samples(spark: SparkSession, sf: str, dataset: str | None = None) -> DataFrame:
    """Scorable samples of one dataset, or of all for None / "" / "all"; an
    unknown name fails with the available names when the query runs."""
    every = fx.samples(spark, sf)
    s = scorable(every).select("sample_id", "dataset", "reference")
    return s if not dataset or dataset == "all" else named_dataset(s, dataset, registry_frame(spark, sf, EVALUATED))


def flt_resolve_selection(spark, sf):
    return load_samples(spark, sf, SELECTED).select("sample_id", "dataset")


def sql_flt_resolve_selection():
    return O.with_recursive(O.utterances_cte(), O.samples_cte()) + \
        f" SELECT sample_id, dataset FROM samples WHERE {O.not_unscorable('reference')} AND dataset = '{SELECTED}'"


def flt_latency_present(spark, sf):
    h = fx.hypotheses(spark, sf)
    return h.groupBy("model").agg(F.count("*").alias("n"), F.count("ttfb").alias("n_ttfb"),
                                  F.count("ttfs").alias("n_ttfs"), F.round(F.avg("ttfb"), 9).alias("ttfb_avg"),
                                  F.round(F.avg("ttfs"), 9).alias("ttfs_avg"))


def sql_flt_latency_present():
    return O.with_recursive(O.utterances_cte(), O.hypotheses_cte()) + """ SELECT model, count(*) AS n,
count(ttfb) AS n_ttfb, count(ttfs) AS n_ttfs, round(avg(ttfb), 9) AS ttfb_avg, round(avg(ttfs), 9) AS ttfs_avg
FROM hyps GROUP BY model"""


# --- audio store -----------------------------------------------------------------------

def join_audio_store(spark, sf):
    """Clips split 70/30 by seeded order get dense audio ids; examples look
    their audio up in the id -> signal store by an equi-join."""
    clips = fx.clips(spark, sf)
    ids = shuffle_split(clips.select(F.col("clip_id").alias("sample_id")))
    store = clips.select(F.col("clip_id").alias("sample_id"), A.quantize(F.col("left")).alias("pcm"))
    examples = ids.select("audio_id", "split", "sample_id")
    return examples.join(store, "sample_id").select("audio_id", F.col("sample_id").alias("clip_id"), "split",
                                                   F.size("pcm").alias("n_samples"))


def sql_join_audio_store():
    return """SELECT shuffle_rank - 1 AS audio_id, clip_id,
CASE WHEN shuffle_rank <= greatest(1, floor(n * 0.7)) THEN 'train' ELSE 'val' END AS split, n_samples
FROM (SELECT vec_id AS clip_id, len(embedding) AS n_samples,
             row_number() OVER (ORDER BY md5('42#' || CAST(vec_id AS VARCHAR)), vec_id) AS shuffle_rank,
             count(*) OVER () AS n FROM embeddings)"""


# --- report lines ------------------------------------------------------------------------
# --- fixed values: the report's wording -----------------------------------------------------
REPORT_WORDS = {
    "sample": "[{i}/{n}]{tag} WER: {wer}% | {latency}", "sample_laser": "[{i}/{n}]{tag} WER: {wer}% | LASER: {laser}% | {latency}",
    "failed": "[{i}/{n}] skipped — error: {error}", "ref": "  REF: {text}", "hyp": "  HYP: {text}",
    "major": "Major: {list}", "minor": "Minor: {list}", "no_penalty": "No penalty: {list}",
    "skipped": "Skipped {n} sample(s) due to errors.", "none": "All samples failed — no results to summarize.",
    "latency": "{name}: avg {avg}s | P95 {p95}s | Min {min}s | Max {max}s",
    "dataset": "WER ({ds}): {wer}% | Samples: {n}", "dataset_laser": "WER ({ds}): {wer}% | Samples: {n} | LASER: {laser}%",
    "overall": "WER: {wer}% | Model: {model} ({mode}) | Samples: {n}", "laser": "LASER: {laser}%",
}
# --------------------------------------------------------------------------------------------


def _parts(template: str) -> list[tuple[bool, str]]:
    """(is a field, text) of a template's pieces."""
    return [(p.startswith("{"), p.strip("{}")) for p in re.split(r"(\{\w+\})", REPORT_WORDS[template]) if p]


def fill(template: str, **fields: Column) -> Column:
    return F.concat(*[fields[p] if f else F.lit(p) for f, p in _parts(template)])


def sql_fill(template: str, **fields: str) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(f"({fields[p]})" if f else quoted(p) for f, p in _parts(template))


def numbered_samples(joined: DataFrame) -> DataFrame:
    """``joined`` (by sample_id, none null) with ``i``, the row's number in sample
    order, and ``n``, the number of rows.  The numbers are made from the ids alone,
    so that texts are neither moved nor written for them; rows of one id lie
    together and count on from the id's first number."""
    ids = range_row_number(joined.select("sample_id"), ["sample_id"], None, out="i")
    first = ids.groupBy("sample_id").agg(F.min("i").alias("_first"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("sample_id"))
    r = joined.join(first, "sample_id").withColumn("i", F.col("_first") + place - 1).drop("_first")
    return one_row_join(r, ids.agg(F.count("*").cast("string").alias("n")))


#: What the summary reads of a sample; it stands beside the sample's first line.
SUMMED = ("dataset", "error", "wer", "ttfb", "ttfs", "laser_score")


def sample_lines(r: DataFrame, laser: bool) -> DataFrame:
    """kind, i, part, line: the lines of every sample that ``numbered_samples``
    has numbered; ``sample``: what the summary reads, at part 0."""
    i, text = F.col("i").cast("string"), {}
    tag = F.when(F.coalesce("dataset", F.lit("")) != "", F.concat(F.lit(" ("), "dataset", F.lit(")"))).otherwise(F.lit(""))
    latency = F.concat_ws(" | ", F.concat(F.lit("TTFB "), fmt_fixed(F.col("ttfb"), 2), F.lit("s")), F.concat(F.lit("TTFS "), fmt_fixed(F.col("ttfs"), 2), F.lit("s")))
    wer = fmt_fixed(F.col("wer") * 100, 1)
    ok, judged = F.col("error").isNull(), F.lit(False)
    text["sample"] = fill("sample", i=i, n=F.col("n"), tag=tag, wer=wer, latency=latency)
    if laser:
        judged = F.col("laser").isNotNull()
        text["sample"] = F.when(judged, fill("sample_laser", i=i, n=F.col("n"), tag=tag, wer=wer, latency=latency, laser=fmt_fixed(
            J.error_pct(F.col("laser.laser_score")), 1))).otherwise(text["sample"])
    lines = [F.struct(F.lit(0).alias("part"), F.when(ok, F.lit("sample")).otherwise(F.lit("failed")).alias("kind"),
                      F.when(ok, text["sample"]).otherwise(fill("failed", i=i, n=F.col("n"), error=F.col("error"))).alias("line"))]
    for part, (kind, column) in enumerate((("ref", "reference"), ("hyp", "text")), 1):
        lines.append(F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.when(ok, fill(kind, text=F.coalesce(column, F.lit("")))).alias("line")))
    if laser:
        found = F.concat_ws(" | ", *[F.when(F.size(F.col(f"laser.{k}_errors")) > 0, fill(k, list=J.error_list(F.col(f"laser.{k}_errors"))))
                                     for k in ("major", "minor", "no_penalty")])
        lines.append(F.struct(F.lit(3).alias("part"), F.lit("errors").alias("kind"), F.when(ok & judged & (found != ""), F.concat(F.lit("  "), found)).alias("line")))
    summed = F.struct(*[c for c in SUMMED if laser or c != "laser_score"]).alias("sample")
    each = r.select("i", summed, F.explode(F.array(*lines)).alias("l")).where("l.line IS NOT NULL")
    return each.select("l.kind", "i", "l.part", "l.line", F.when(F.col("l.part") == 0, F.col("sample")).alias("sample"))


def summary_lines(results: DataFrame, laser: bool, model: str = REPORT_MODEL, mode: str = REPORT_MODE) -> DataFrame:
    """kind, dataset, line: skipped samples, then latencies, datasets and
    totals, or the one line that there is nothing to summarise."""
    s = eval_summary(results, laser=laser)
    ov, ds = s.where(F.col("level") == "overall"), s.where(F.col("level") == "dataset")
    some = ov.where("scored > 0")

    def lines(kind: str, rows: DataFrame, line: Column) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "dataset", line.alias("line"))
    out = lines("skipped", ov.where("skipped > 0"), fill("skipped", n=F.col("skipped").cast("string")))
    out = out.unionByName(lines("none", ov.where("scored = 0"), F.lit(REPORT_WORDS["none"])))
    for c in ("ttfb", "ttfs"):
        out = out.unionByName(lines(c, some.where(F.col(f"{c}_avg").isNotNull()), fill("latency", name=F.lit(c.upper()), **{
            k: fmt_fixed(F.col(f"{c}_{k}"), 2) for k in ("avg", "p95", "min", "max")})))
    wer, n = fmt_fixed(F.col("wer_pct"), 2), F.col("scored").cast("string")
    each = fill("dataset_laser", ds=F.col("dataset"), wer=wer, n=n, laser=fmt_fixed(F.col("laser_pct_all"), 2)) if laser else fill(
        "dataset", ds=F.col("dataset"), wer=wer, n=n)
    out = out.unionByName(lines("dataset", ds, each))
    out = out.unionByName(lines("overall", some, fill("overall", wer=wer, model=F.lit(model), mode=F.lit(mode), n=F.col("attempted").cast("string"))))
    if laser:
        out = out.unionByName(lines("laser", some.where("laser_pct_scored IS NOT NULL"), fill("laser", laser=fmt_fixed(F.col("laser_pct_scored"), 2))))
    return out


def report_lines(joined: DataFrame, path: str, laser: bool = True) -> DataFrame:
    """The whole report of ``judged_samples``; samples first (numbered), then the
    summary.  A sample's lines are written where it is scored: the table of lines
    is the run's only one, and the summary, made from it, is written behind it."""
    spark = joined.sparkSession
    samples = sample_lines(judged_results(numbered_samples(joined)), laser).withColumn("dataset", F.lit(None).cast("string"))
    columns = ["kind", "dataset", "i", "part", "line"]
    samples.select(*columns, "sample").write.option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path)
    rest = summary_lines(written.where("part = 0").select("sample.*"), laser)
    rest = rest.withColumns({c: F.lit(None).cast(written.schema[c].dataType) for c in ("i", "part", "sample")})
    rest.select(*written.columns).write.mode("append").parquet(path)
    return spark.read.schema(written.schema).parquet(path).select(*columns)


def snk_report(spark, sf):
    """The report of a judged run, written as text lines with their order and
    read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/report/{uuid.uuid4().hex}"
    return report_lines(judged_samples(spark, sf), path)


def sql_snk_report():
    from .judging import _laser_ctes
    f = sql_fmt_fixed
    quote = r"""CASE WHEN contains(e, '''') AND NOT contains(e, '"') THEN '"' || replace(e, '\', '\\') || '"'
ELSE '''' || replace(replace(e, '\', '\\'), '''', '\''') || '''' END"""
    errors = lambda k: sql_fill(k, list=f"'[' || array_to_string(list_transform(l_{k}_errors, lambda e: {quote}), ', ') || ']'")
    latency = f"concat_ws(' | ', 'TTFB ' || {f('ttfb', 2)} || 's', 'TTFS ' || {f('ttfs', 2)} || 's')"
    tag = "CASE WHEN coalesce(dataset, '') <> '' THEN ' (' || dataset || ')' ELSE '' END"
    common = dict(i="CAST(i AS VARCHAR)", n="CAST(n AS VARCHAR)", tag=tag, wer=f("wer * 100", 1), latency=latency)
    laser_pct = f("(1.0 - laser_score) * 100", 1)
    listed = ", ".join(f"CASE WHEN len(l_{k}_errors) > 0 THEN {errors(k)} END" for k in ("major", "minor", "no_penalty"))
    lat = " UNION ALL ".join(
        f"SELECT '{c}', dataset, NULL, NULL, " + sql_fill("latency", name=f"'{c.upper()}'", **{k: f(f"{c}_{k}", 2) for k in ("avg", "p95", "min", "max")})
        + f" FROM summ WHERE level = 'overall' AND scored > 0 AND {c}_avg IS NOT NULL" for c in ("ttfb", "ttfs"))
    total = {"wer": f("wer_pct", 2)}
    overall = sql_fill("overall", model=f"'{REPORT_MODEL}'", mode=f"'{REPORT_MODE}'", n="CAST(attempted AS VARCHAR)", **total)
    ds_line = sql_fill("dataset_laser", ds="dataset", n="CAST(scored AS VARCHAR)", laser=f("laser_pct_all", 2), **total)
    return O.with_recursive(*_laser_ctes(), f"summ AS ({summary_sql('lasered', laser=True)})", """
numbered AS (
  SELECT l.*, j.reference, j.text, row_number() OVER (ORDER BY sample_id) AS i, count(*) OVER () AS n
  FROM lasered l JOIN joined j USING (sample_id)
)""") + f"""
SELECT CASE WHEN error IS NULL THEN 'sample' ELSE 'failed' END AS kind, CAST(NULL AS VARCHAR) AS dataset, i, 0 AS part,
  CASE WHEN error IS NOT NULL THEN {sql_fill('failed', error='error', i=common['i'], n=common['n'])}
       ELSE {sql_fill('sample_laser', laser=laser_pct, **common)} END AS line FROM numbered
UNION ALL SELECT 'ref', NULL, i, 1, {sql_fill('ref', text="coalesce(reference, '')")} FROM numbered WHERE error IS NULL
UNION ALL SELECT 'hyp', NULL, i, 2, {sql_fill('hyp', text="coalesce(text, '')")} FROM numbered WHERE error IS NULL
UNION ALL SELECT 'errors', NULL, i, 3, '  ' || found FROM (SELECT i, concat_ws(' | ', {listed}) AS found FROM numbered WHERE error IS NULL) WHERE found <> ''
UNION ALL SELECT 'skipped', dataset, NULL, NULL, {sql_fill('skipped', n='CAST(skipped AS VARCHAR)')} FROM summ WHERE level = 'overall' AND skipped > 0
UNION ALL SELECT 'none', dataset, NULL, NULL, '{REPORT_WORDS['none']}' FROM summ WHERE level = 'overall' AND scored = 0
UNION ALL {lat}
UNION ALL SELECT 'dataset', dataset, NULL, NULL, {ds_line} FROM summ WHERE level = 'dataset'
UNION ALL SELECT 'overall', dataset, NULL, NULL, {overall} FROM summ WHERE level = 'overall' AND scored > 0
UNION ALL SELECT 'laser', dataset, NULL, NULL, {sql_fill('laser', laser=f('laser_pct_scored', 2))} FROM summ WHERE level = 'overall' AND scored > 0 AND laser_pct_scored IS NOT NULL"""


# --- streams -------------------------------------------------------------------------------

RESULTS_SCHEMA = "sample_id long, dataset string, error string, wer double"


def st_running_metrics(spark, sf):
    r = eval_results(spark, sf).select("sample_id", "dataset", "error", "wer")
    path = replay.scratch(spark, "results_feed")
    replay.stage_slices(r, path, "sample_id")
    return replay.running_metrics(spark, path, RESULTS_SCHEMA)


def sql_st_running_metrics():
    return O.with_recursive(*results_sql()) + """ SELECT dataset, count(*) AS samples,
round(avg(wer) * 100, 9) AS wer_pct FROM results WHERE error IS NULL GROUP BY dataset"""


PROMPT_SCHEMA = "prompt string, candidate_id int, ts timestamp, shuffle_rank long"


def st_prompt_dedup(spark, sf):
    c = candidate_scores(spark, sf, ranked=True).select("prompt", "candidate_id", F.timestamp_seconds("shuffle_rank").alias("ts"),
                                           "shuffle_rank")
    path = replay.scratch(spark, "prompt_feed")
    replay.stage_slices(c, path, "shuffle_rank")
    return replay.prompt_dedup(spark, path, PROMPT_SCHEMA).select("prompt", "candidate_id")


def sql_st_prompt_dedup():
    from .optimize import _opt
    return _opt(" SELECT DISTINCT prompt, CAST(candidate_id AS INTEGER) AS candidate_id FROM pairs")


def udaf_greedy_windows(spark, sf):
    return win_greedy_windows(spark, sf)


def sql_udaf_greedy_windows():
    from .tools import sql_win_greedy_windows
    return sql_win_greedy_windows()


# --- Python-side operators -----------------------------------------------------------------

def _ok_results(spark, sf):
    return eval_results(spark, sf).where(F.col("error").isNull()).select("sample_id", "norm_ref", "norm_hyp")


def udf_align(spark, sf):
    """Alignment per pair: edit count (optimal, equals the WER numerator)."""
    ops = align_ops(_ok_results(spark, sf))
    return ops.groupBy("sample_id").agg(F.count_if(F.col("op") != "ok").alias("edits"),
                                        F.count_if(F.col("ref_word").isNotNull()).alias("ref_words"))


def sql_udf_align():
    return O.with_recursive(*results_sql()) + """ SELECT sample_id, edits, ref_words FROM results
WHERE error IS NULL AND NOT (norm_ref = '' AND norm_hyp = '')"""


def laser_rubric_native(spark, sf):
    """The rubric as rules, without a judge.  No twin: the table of a line of
    thousands of words is too slow in SQL; ``tests/test_rubric.py`` holds it
    against SQL and the definition on small texts."""
    return rubric_scores(_ok_results(spark, sf))


def udf_enrich(spark, sf):
    """A caller's Python scorer (here: hypothesis word counts of a list of
    texts) applied to every result row through the enrichment wrapper."""
    r = eval_results(spark, sf).select("sample_id", "norm_hyp")
    out = enrich(r, "norm_hyp", lambda texts: [len(t.split()) for t in texts], "hyp_words", "int")
    return out.select("sample_id", "hyp_words", "hyp_words_error")


def sql_udf_enrich():
    return O.with_recursive(*results_sql()) + """ SELECT sample_id,
CAST(len(list_filter(string_split(norm_hyp, ' '), lambda w: w <> '')) AS INTEGER) AS hyp_words,
CAST(NULL AS VARCHAR) AS hyp_words_error FROM results"""


_KEYS = ("flt_resolve_selection", "flt_latency_present", "join_audio_store", "snk_report",
         "st_running_metrics", "st_prompt_dedup", "udaf_greedy_windows",
         "udf_align", "laser_rubric_native", "udf_enrich")
QUERIES = {k: globals()[k] for k in _KEYS}
ORACLE = {k: globals()["sql_" + k] for k in _KEYS if "sql_" + k in globals()}
