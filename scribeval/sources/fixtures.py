"""Evaluation inputs derived from the given tables.

The test tables hold no speech, so the evaluation inputs are derived from
them by fixed, engine-neutral rules (the same rules are written in DuckDB SQL
by ``scribeval.plans.oracle``):

* ``utterances``: every line of every document (split on line ends, whole
  lines, nothing cut) plus every ``benchmark`` item.  One row = one sample; its
  dataset is the registry's entry of the row.
* ``samples``: utterances with the two unscorable markers and empty
  references injected at fixed id residues (they occur in no document).
* ``hypotheses``: a transcription per sample, made from the reference by
  fixed word-index edits (drops, substitutions, inserted fillers), with
  failures, latencies and a model name.
* ``judge_replies``: a raw JSON judge reply per sample, in five shapes
  (canonical keys, alias keys, lists given as strings, out-of-range score,
  missing/wrong field) plus nulls.
* ``clips``, ``turns``, ``steps``, ``text_lines``, ``catalog`` ...: see the
  individual functions.

All functions are lazy DataFrame builders; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import split_words
from ..operators.search import split_lines
from .registry import document_dataset
from .tables import read_events, read_table

# --- fixed values -----------------------------------------------------------
IGNORE_MARKER = "ignore_time_segment_in_scoring"
STREAMING_MODEL = "stream-v3"
BATCH_MODEL = "batch-v3"
LINE_BREAK = r"\r?\n"
# Sample ids of document lines: (doc_id + 1) * LINE_ID_BASE + line_no; benchmark
# items take the ids below 0.  A text with more lines raises an error.
LINE_ID_BASE = 1 << 24
BENCHMARK_DATASET = "benchmark"
TURN_SPEED = 3600
# ---------------------------------------------------------------------------


def utterances(spark: SparkSession, sf_dir: str, for_join: bool = False) -> DataFrame:
    """sample_id, dataset, lang, text: document lines and benchmark items.

    With ``for_join`` the rows are hash-partitioned on sample_id once, so
    that the tables derived from them (samples, hypotheses, judge replies) meet
    without further shuffles; filters and projections need no shuffle."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    line_no = F.when(F.col("line_no") < LINE_ID_BASE, F.col("line_no")).otherwise(
        F.raise_error(F.lit("a text has more lines than sample ids allow")).cast("int"))
    lines = docs.select(
        "doc_id", document_dataset(F.col("doc_id"), F.col("lang")).alias("dataset"), "lang",
        F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_BREAK)).alias("line_no", "line"),
    ).select(
        ((F.col("doc_id") + 1) * LINE_ID_BASE + line_no).alias("sample_id"),
        "dataset",
        "lang",
        F.col("line").alias("text"),
    )
    bench = read_table(spark, sf_dir, "benchmark").select(
        (-(F.col("item_id") + 1)).alias("sample_id"),
        F.lit(BENCHMARK_DATASET).alias("dataset"),
        F.lit("en").alias("lang"),
        "text",
    )
    both = lines.unionByName(bench)
    return both.repartition(_partitions(spark), "sample_id") if for_join else both


def _partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def inject_reference(sample_id: Column, text: Column) -> Column:
    return (
        F.when(sample_id % 19 == 0, F.lit("  " + IGNORE_MARKER + " "))
        .when(sample_id % 23 == 0, F.concat(F.lit("[INAUDIBLE] "), text))
        .when(sample_id % 31 == 0, F.lit(""))
        .otherwise(text)
    )


def samples(spark: SparkSession, sf_dir: str, for_join: bool = False) -> DataFrame:
    """X1: sample_id, dataset, lang, reference."""
    u = utterances(spark, sf_dir, for_join)
    return u.select(
        "sample_id", "dataset", "lang",
        inject_reference(F.col("sample_id"), F.col("text")).alias("reference"),
    )


def edited_text(words: Column) -> Column:
    """Fixed word-index edits turning a reference into a hypothesis; words that
    are left out become null, which ``array_join`` passes over."""
    def one(w, i):
        sub = F.when(i % 11 == 5, F.lit("zz")).otherwise(w)
        return F.when(i % 7 == 3, F.lit(None).cast("string")).when(i % 13 == 6, F.concat(sub, F.lit(" uh"))).otherwise(sub)
    return F.array_join(F.transform(words, one), " ")


def hypotheses(spark: SparkSession, sf_dir: str, for_join: bool = False) -> DataFrame:
    """X3: sample_id, model, text, ttfb, ttfs, error."""
    u = utterances(spark, sf_dir, for_join)
    sid = F.col("sample_id")
    hyp = edited_text(split_words(F.col("text")))
    model = F.when(sid % 2 == 0, F.lit(STREAMING_MODEL)).otherwise(F.lit(BATCH_MODEL))
    error = F.when(
        sid % 17 == 0,
        F.when(sid % 34 == 0, F.lit("no spoken audio")).otherwise(F.lit("server error 500")),
    )
    ttfs = (F.abs(sid) % 50) / F.lit(10.0) + F.lit(0.5)
    return u.select(
        "sample_id",
        model.alias("model"),
        F.when(error.isNull(), F.when(sid % 29 == 0, F.lit("")).otherwise(hyp)).alias("text"),
        F.when(error.isNull() & (model == STREAMING_MODEL), ttfs / 4).alias("ttfb"),
        F.when(error.isNull(), ttfs).alias("ttfs"),
        error.alias("error"),
    )


def _positions(words: Column, pred) -> Column:
    idx = F.transform(words, lambda w, i: F.when(pred(i), i))
    return F.filter(idx, lambda i: i.isNotNull())


def judge_replies(spark: SparkSession, sf_dir: str, for_join: bool = False) -> DataFrame:
    """X4: sample_id, raw (judge reply JSON text or null)."""
    u = utterances(spark, sf_dir, for_join).select("sample_id", split_words(F.col("text")).alias("w"))
    w = F.col("w")
    n = F.size(w)
    # The lists stand in a projection of their own: each is made once, not once
    # for every value that is derived from it.
    major = F.transform(_positions(w, lambda i: (i % 11 == 5) & (i % 7 != 3)),
                        lambda i: F.concat(F.lit("'"), F.get(w, i), F.lit("' -> 'zz'")))
    minor = F.transform(_positions(w, lambda i: i % 7 == 3),
                        lambda i: F.concat(F.lit("omitted '"), F.get(w, i), F.lit("'")))
    nopen = F.transform(_positions(w, lambda i: (i % 13 == 6) & (i % 7 != 3)),
                        lambda i: F.concat(F.lit("filler 'uh' after '"), F.get(w, i), F.lit("'")))
    u = u.select("sample_id", n.alias("n"), major.alias("major"), minor.alias("minor"), nopen.alias("nopen"))
    n, major, minor, nopen = (F.col(c) for c in ("n", "major", "minor", "nopen"))
    penalty = (F.size(major) + F.size(minor) * F.lit(0.5)).cast("double")
    score = F.when(n == 0, F.lit(1.0)).otherwise(F.lit(1.0) - penalty / n)
    sid = F.col("sample_id")
    v = sid % 5

    canonical = F.to_json(F.struct(
        n.alias("word_count"), nopen.alias("no_penalty_errors"), major.alias("major_errors"),
        minor.alias("minor_errors"), penalty.alias("total_penalty"), score.alias("laser_score")))
    aliased = F.to_json(F.struct(
        n.alias("word_count"), nopen.alias("non_penalizable_errors"),
        major.alias("major_penalizable_errors"), minor.alias("minor_penalizable_errors"),
        penalty.alias("total_penalty"), score.alias("score")))
    as_strings = F.to_json(F.struct(
        n.alias("word_count"),
        F.lit("").alias("no_penalty_errors"),
        F.to_json(major).alias("major_errors"),
        F.coalesce(F.get(minor, 0), F.lit("")).alias("minor_errors"),
        penalty.alias("total_penalty"), score.alias("laser_score")))
    out_of_range = F.to_json(F.struct(
        n.alias("word_count"), nopen.alias("no_penalty_errors"), major.alias("major_errors"),
        minor.alias("minor_errors"), penalty.alias("total_penalty"),
        (score * 2 - F.lit(0.5)).alias("laser_score")))
    missing = F.to_json(F.struct(
        n.alias("word_count"), nopen.alias("no_penalty_errors"), major.alias("major_errors"),
        minor.alias("minor_errors"), score.alias("laser_score")))
    wrong_type = F.to_json(F.struct(
        F.lit("many").alias("word_count"), nopen.alias("no_penalty_errors"),
        major.alias("major_errors"), minor.alias("minor_errors"),
        penalty.alias("total_penalty"), score.alias("laser_score")))
    raw = (
        F.when(sid % 41 == 0, F.lit(None).cast("string"))
        .when(v == 0, canonical)
        .when(v == 1, aliased)
        .when(v == 2, as_strings)
        .when(v == 3, out_of_range)
        .when(sid % 10 == 4, missing)
        .otherwise(wrong_type)
    )
    return u.select("sample_id", raw.alias("raw"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5: clip_id, label, sampling_rate, mono ARRAY<DOUBLE>, right ARRAY<DOUBLE>.

    ``embeddings`` stand in for audio: the vector is the left channel, its
    reverse the right channel; the rate is 8, 16 or 22.05 kHz by label."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    arr = F.transform("embedding", lambda x: x.cast("double"))
    rate = (F.when(F.col("label") % 3 == 0, F.lit(8000))
            .when(F.col("label") % 3 == 1, F.lit(16000)).otherwise(F.lit(22050)))
    return e.select(
        F.col("vec_id").alias("clip_id"), "label", rate.alias("sampling_rate"),
        arr.alias("left"), F.reverse(arr).alias("right"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips long enough for several chunks: the vectors of one label within
    256 successive ids, laid end to end in id order; named by the first id."""
    whole = clips(spark, sf_dir).groupBy("label", "sampling_rate", F.floor(F.col("clip_id") / 256).alias("_part")).agg(
        F.min("clip_id").alias("clip_id"), F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("clip_id", "left"))), lambda c: c["left"])).alias("left"))
    return whole.select("clip_id", "label", "sampling_rate", "left", F.reverse("left").alias("right"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6: turn events per streaming session (``events`` per user).

    purchase -> final turn, view/click -> partial turn, error -> error,
    signup -> termination.  An hour of the table plays as a second, so that
    calls with and without silences of 30 seconds occur."""
    ev = read_events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    kind = (F.when(et.isin("purchase", "view", "click"), F.lit("turn"))
            .when(et == "error", F.lit("error")).when(et == "signup", F.lit("termination"))
            .otherwise(F.lit("other")))
    return ev.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        F.timestamp_micros(F.floor(F.unix_micros("ts") / F.lit(TURN_SPEED)).cast("long")).alias("ts"),
        kind.alias("kind"),
        F.when(et.isin("purchase", "view", "click"), et == "purchase").alias("end_of_turn"),
        F.when(et.isin("purchase", "view", "click"),
               F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("transcript"),
        F.when(et == "error", F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"),
        F.col("value").alias("latency"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7: agent steps (conv_id, turn, role, text); every third turn gets the
    two boilerplate header lines and a blank line in front."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.when(
        F.col("turn") % 3 == 0,
        F.concat(F.lit("Execution logs:\n\nLast output from code snippet:\n"), F.col("text")),
    ).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", text.alias("text"))


def searchable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8: every page (``html``) and document (``text``) as (doc_id, body);
    pages keep page_id, documents use -(doc_id + 1)."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("body"))
    docs = read_table(spark, sf_dir, "documents").select(
        (-(F.col("doc_id") + 1)).alias("doc_id"), F.col("text").alias("body"))
    return pages.unionByName(docs)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of the searchable texts; line_no from 0."""
    return searchable_texts(spark, sf_dir).select(
        "doc_id", F.posexplode(split_lines(F.col("body"))).alias("line_no", "line"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10 catalogue: one entry per document source.

    id = source; downloads = sum(n_chars); languages = sorted distinct langs;
    description blank for sources whose number is even, pretty_name =
    upper-case id; task by the number; card_description = text of the source's lowest doc_id."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    agg = d.groupBy("source").agg(
        F.sum("n_chars").alias("downloads"),
        F.array_sort(F.collect_set("lang")).alias("languages"),
        F.min_by("text", "doc_id").alias("first_text"),
        F.count("*").alias("n_docs"),
    )
    num = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return agg.select(
        F.col("source").alias("id"),
        "downloads",
        F.when(num % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Speech-like corpus "), "source")).alias("description"),
        F.when(num % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("first_text")).alias("card_description"),
        F.upper("source").alias("pretty_name"),
        "languages",
        "n_docs",
        F.when(num % 4 == 3, F.lit("audio-classification")).otherwise(F.lit("automatic-speech-recognition")).alias("task"),
    )
