"""Corpus assembly, sampling, joins and per-sample scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import split_words
from ..functions.strings import fmt_fixed, sql_fmt_fixed
from ..operators.sampling import progress_labels, shuffle_split
from ..operators.scoring import with_normalized
from ..operators.selection import (
    even_quota,
    named_dataset,
    not_ignore_marker,
    not_inaudible,
    resolve_selection,
    scorable,
    with_quota,
)
from ..operators.summary import eval_summary
from ..operators.wordmap import map_words
from ..sources import fixtures as fx
from ..sources.registry import EVALUATED, NO_LANGUAGE, DatasetEntry, document_dataset, registry, registry_frame, split_of
from ..sources.tables import read_table
from . import oracle as O
from .evaluation import eval_results, results_sql, scoring_partitions

QUOTA_TOTAL = 1000
NAMED_DATASET = "benchmark"
FIRST_N = 50
FIRST_N_DATASET = "documents-en-test"
PROMPT = "Transcribe verbatim."
# --- fixed values: model routing ----------------------------------------------
STREAMING_MODELS = ("stream-v3", "stream-english", "stream-multilingual")
PROMPT_MODELS = ("stream-v3",)
# ------------------------------------------------------------------------------


def _scorable_samples(spark, sf):
    return scorable(fx.samples(spark, sf))


def _ctes(*extra):
    return O.with_recursive(O.utterances_cte(), O.samples_cte(), O.hypotheses_cte(), *extra)


SCORABLE = f"(SELECT * FROM samples WHERE {O.not_unscorable('reference')})"


# --- sources -------------------------------------------------------------------

ADHOC = DatasetEntry("benchmark", None, "item_id", "text", "test")


def map_columns(df: DataFrame, entry: DatasetEntry, name: str) -> DataFrame:
    """prj_map_columns: configured audio/text columns -> audio, reference."""
    return df.select(F.col(entry.audio_column).alias("audio"), F.col(entry.text_column).alias("reference"),
                     F.lit(name).alias("dataset"))


def scan_entry(spark, sf, entry: DatasetEntry, name: str) -> DataFrame:
    """The rows of one entry: two columns, filtered by its configuration (a
    language) and split."""
    df = read_table(spark, sf, entry.path)
    if entry.config is not None:
        lang = F.col("lang")
        df = df.where((lang == entry.config) | lang.isNull() if entry.config == NO_LANGUAGE else lang == entry.config)
    if entry.path == "documents":
        df = df.where(split_of(F.col("doc_id")) == entry.split)
    return map_columns(df, entry, name)


def scan_all(spark, sf, entries: dict[str, DatasetEntry]) -> DataFrame:
    """The rows of many entries.  The entries of ``documents`` share one scan:
    a row's language and split name its entry."""
    name = document_dataset(F.col("doc_id"), F.col("lang"))
    frames = [read_table(spark, sf, "documents").select(F.col("doc_id").alias("audio"), F.col("text").alias("reference"), name.alias("dataset"))]
    frames += [scan_entry(spark, sf, e, n) for n, e in entries.items() if e.path != "documents"]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def load_datasets(spark, sf, dataset: str | None = None, adhoc: DatasetEntry | None = None) -> DataFrame:
    """audio, reference, dataset of the chosen entries, scorable rows only: an
    ad-hoc entry replaces the registry and is called 'custom', a name picks
    one entry, None / "" / "all" keeps all; an unknown name is an error that
    lists the names."""
    entries = registry(spark, sf)
    names = resolve_selection(list(entries), dataset, adhoc)
    if adhoc is not None:
        out = scan_entry(spark, sf, adhoc, "custom")
    elif len(names) == 1:
        out = scan_entry(spark, sf, entries[names[0]], names[0])
    else:
        out = scan_all(spark, sf, entries)
    return scorable(out)


def src_registry(spark, sf):
    """The registry with the rows each entry has."""
    entries = registry(spark, sf)
    rows = [(n, i, e.path, e.config, e.audio_column, e.text_column, e.split) for i, (n, e) in enumerate(entries.items())]
    frame = spark.createDataFrame(rows, "dataset string, position int, path string, config string, "
                                        "audio_column string, text_column string, split string")
    counts = scan_all(spark, sf, entries).groupBy("dataset").agg(F.count("*").alias("rows"))
    return frame.join(counts, "dataset", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


#: Every row of every table with its entry, written from the tables.
EVERY_ROW = f"""
  SELECT doc_id AS audio, text AS reference, {O.DOCUMENT_DATASET} AS dataset FROM documents
  UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark
  UNION ALL SELECT turn, text, 'conversations' FROM conversations
  UNION ALL SELECT page_id, html, 'pages' FROM pages"""


def sql_src_registry():
    return f"""WITH {O.registry_cte()},
counts AS (SELECT dataset, count(*) AS rows FROM ({EVERY_ROW}) GROUP BY dataset)
SELECT r.dataset, CAST(position AS INTEGER) AS position, split_part(r.dataset, '-', 1) AS path,
  CASE WHEN r.dataset LIKE 'documents-%' THEN regexp_extract(r.dataset, '^documents-(.*)-(test|train)$', 1) END AS config,
  CASE split_part(r.dataset, '-', 1) WHEN 'documents' THEN 'doc_id' WHEN 'benchmark' THEN 'item_id' WHEN 'pages' THEN 'page_id' ELSE 'turn' END AS audio_column,
  CASE WHEN r.dataset = 'pages' THEN 'html' ELSE 'text' END AS text_column,
  CASE WHEN r.dataset LIKE '%-train' THEN 'train' ELSE 'test' END AS split, coalesce(rows, 0) AS rows
FROM registry r LEFT JOIN counts USING (dataset)"""


def src_multi_union(spark, sf):
    """All entries of the registry concatenated: every row of the tables."""
    return load_datasets(spark, sf)


def sql_src_multi_union():
    return f"SELECT audio, reference, dataset FROM ({EVERY_ROW}) WHERE {O.not_unscorable('reference')}"


def doc_split(spark, sf) -> DataFrame:
    """documents with split = 'test' when the document has a label row."""
    d = read_table(spark, sf, "documents").select("doc_id", "source", "lang")
    lab = read_table(spark, sf, "labels").select("doc_id").distinct().withColumn("_lab", F.lit(True))
    return d.join(lab, "doc_id", "left").select(
        "doc_id", "source", "lang",
        F.when(F.col("_lab"), F.lit("test")).otherwise(F.lit("train")).alias("split"))


def src_scan_split(spark, sf):
    """One entry's scan: its configuration and split, two columns read."""
    return load_datasets(spark, sf, "documents-en-test")


def sql_src_scan_split():
    return f"SELECT * FROM ({EVERY_ROW}) WHERE dataset = 'documents-en-test' AND {O.not_unscorable('reference')}"


def src_adhoc_override(spark, sf):
    """An ad-hoc dataset replaces the registry: one entry called 'custom'."""
    return load_datasets(spark, sf, adhoc=ADHOC)


def sql_src_adhoc_override():
    return f"""SELECT item_id AS audio, text AS reference, 'custom' AS dataset FROM benchmark
WHERE {O.not_unscorable('text')}"""


CONV_ENTRY = DatasetEntry("conversations", None, "turn", "text", "test")


def prj_map_columns(spark, sf):
    return map_columns(read_table(spark, sf, "conversations"), CONV_ENTRY, "conversations")


def sql_prj_map_columns():
    return "SELECT turn AS audio, text AS reference, 'conversations' AS dataset FROM conversations"


# --- filters -------------------------------------------------------------------

def flt_ignore_marker(spark, sf):
    s = fx.samples(spark, sf)
    return s.where(not_ignore_marker(F.col("reference"))).select("sample_id", "dataset")


def sql_flt_ignore_marker():
    return _ctes() + f""" SELECT sample_id, dataset FROM samples
WHERE NOT coalesce(regexp_replace(reference, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g') = '{fx.IGNORE_MARKER}', false)"""


def flt_inaudible(spark, sf):
    s = fx.samples(spark, sf)
    return s.where(not_inaudible(F.col("reference"))).select("sample_id", "dataset")


def sql_flt_inaudible():
    return _ctes() + """ SELECT sample_id, dataset FROM samples
WHERE NOT coalesce(contains(lower(reference), 'inaudible'), false)"""


def flt_named_dataset(spark, sf):
    """One dataset by name; a name that occurs nowhere is an error of the
    query itself that lists the names there are (no job while planning)."""
    every = fx.samples(spark, sf)
    return named_dataset(scorable(every), NAMED_DATASET, registry_frame(spark, sf, EVALUATED)).select("sample_id", "dataset", "reference")


def sql_flt_named_dataset():
    return _ctes() + f" SELECT sample_id, dataset, reference FROM {SCORABLE} WHERE dataset = '{NAMED_DATASET}'"


# --- quota, limit, split ---------------------------------------------------------

def win_even_quota(spark, sf):
    every = fx.samples(spark, sf)
    return even_quota(scorable(every).select("sample_id", "dataset"), QUOTA_TOTAL, registry=registry_frame(spark, sf, EVALUATED))


def _quota_sql(total: int) -> str:
    return f"""{O.registry_cte(evaluated=True)},
reg AS (
  SELECT dataset, CAST(position AS INTEGER) AS position, {total} // n + CASE WHEN position < {total} % n THEN 1 ELSE 0 END AS quota
  FROM (SELECT dataset, position, count(*) OVER () AS n FROM registry)
),
ranked AS (
  SELECT sample_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) AS rn FROM {SCORABLE}
)"""


def sql_win_even_quota():
    return _ctes(_quota_sql(QUOTA_TOTAL)) + """
SELECT r.sample_id, r.dataset, r.rn FROM ranked r JOIN reg USING (dataset) WHERE r.rn <= reg.quota"""


def join_registry(spark, sf):
    s = _scorable_samples(spark, sf)
    reg = with_quota(registry_frame(spark, sf, EVALUATED), QUOTA_TOTAL).select("dataset", "position", "quota")
    return s.join(reg, "dataset").select("sample_id", "dataset", "position", "quota")


def sql_join_registry():
    return _ctes(_quota_sql(QUOTA_TOTAL)) + f"""
SELECT s.sample_id, s.dataset, reg.position, reg.quota FROM {SCORABLE} s JOIN reg USING (dataset)"""


def lim_first_n(spark, sf):
    s = _scorable_samples(spark, sf).where(F.col("dataset") == FIRST_N_DATASET)
    return s.orderBy("sample_id").limit(FIRST_N).select("sample_id", "dataset")


def sql_lim_first_n():
    return _ctes() + f""" SELECT sample_id, dataset FROM {SCORABLE} WHERE dataset = '{FIRST_N_DATASET}'
ORDER BY sample_id LIMIT {FIRST_N}"""


def win_shuffle_split(spark, sf):
    s = _scorable_samples(spark, sf).select("sample_id", "dataset")
    return shuffle_split(s)


def _split_sql() -> str:
    return f"""
split AS (
  SELECT sample_id, dataset, shuffle_rank,
         CASE WHEN shuffle_rank <= greatest(1, floor(n * 0.7)) THEN 'train' ELSE 'val' END AS split,
         shuffle_rank - 1 AS audio_id
  FROM (SELECT sample_id, dataset,
               row_number() OVER (ORDER BY md5('42#' || CAST(sample_id AS VARCHAR)), sample_id) AS shuffle_rank,
               count(*) OVER () AS n
        FROM {SCORABLE})
)"""


def sql_win_shuffle_split():
    return _ctes(_split_sql()) + " SELECT * FROM split"


def win_audio_id(spark, sf):
    return win_shuffle_split(spark, sf).select("audio_id", "sample_id", "split")


def sql_win_audio_id():
    return _ctes(_split_sql()) + " SELECT audio_id, sample_id, split FROM split"


# --- joins and counts -------------------------------------------------------------

def _joined(spark, sf):
    s = scorable(fx.samples(spark, sf, for_join=True))
    h = fx.hypotheses(spark, sf, for_join=True)
    return s.join(h, "sample_id")


JOINED_SQL = f"(SELECT s.sample_id, s.dataset, s.reference, h.text, h.model, h.ttfb, h.ttfs, h.error " \
             f"FROM {SCORABLE} s JOIN hyps h USING (sample_id))"


def join_sample_hypothesis(spark, sf):
    return _joined(spark, sf).select("sample_id", "dataset", "reference", "text", "model", "error")


def sql_join_sample_hypothesis():
    return _ctes() + f" SELECT sample_id, dataset, reference, text, model, error FROM {JOINED_SQL}"


def join_skipped_anti(spark, sf):
    s = _scorable_samples(spark, sf)
    ok = fx.hypotheses(spark, sf).where(F.col("error").isNull()).select("sample_id")
    return s.join(ok, "sample_id", "left_anti").select("sample_id", "dataset")


def sql_join_skipped_anti():
    return _ctes() + f""" SELECT sample_id, dataset FROM {SCORABLE} s
WHERE NOT EXISTS (SELECT 1 FROM hyps h WHERE h.sample_id = s.sample_id AND h.error IS NULL)"""


def agg_run_counts(spark, sf):
    j = _joined(spark, sf)
    return j.agg(F.count("*").alias("attempted"), F.count_if(F.col("error").isNull()).alias("scored"),
                 F.count_if(F.col("error").isNotNull()).alias("skipped")).withColumn(
        "all_failed", F.col("scored") == 0)


def sql_agg_run_counts():
    return _ctes() + f""" SELECT count(*) AS attempted, count(*) FILTER (WHERE error IS NULL) AS scored,
count(*) FILTER (WHERE error IS NOT NULL) AS skipped, count(*) FILTER (WHERE error IS NULL) = 0 AS all_failed
FROM {JOINED_SQL}"""


def win_progress(spark, sf):
    return progress_labels(_joined(spark, sf).select("sample_id", "dataset"), "dataset", "sample_id")


def sql_win_progress():
    return _ctes() + f""" SELECT sample_id, dataset, i, total, CAST(i AS VARCHAR) || '/' || CAST(total AS VARCHAR) AS label
FROM (SELECT sample_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) AS i,
             count(*) OVER (PARTITION BY dataset) AS total FROM {JOINED_SQL})"""


def flt_error_triage(spark, sf):
    h = fx.hypotheses(spark, sf)
    err = F.col("error")
    return h.select("sample_id", F.when(err.isNull(), F.col("text")).otherwise(F.lit("")).alias("transcription"),
                    (err.isNotNull() & ~err.contains("no spoken audio")).alias("report"))


def sql_flt_error_triage():
    return _ctes() + """ SELECT sample_id, CASE WHEN error IS NULL THEN text ELSE '' END AS transcription,
(error IS NOT NULL AND NOT contains(error, 'no spoken audio')) AS report FROM hyps"""


def prj_route_model(spark, sf):
    h = fx.hypotheses(spark, sf)
    m = F.col("model")
    return h.select("sample_id", "model",
                    F.when(m.isin(*STREAMING_MODELS), "streaming").otherwise("batch").alias("api_mode"),
                    F.when(m.isin(*PROMPT_MODELS) & (F.lit(PROMPT) != ""), F.lit(PROMPT)).alias("prompt"))


def sql_prj_route_model():
    sm = ", ".join(f"'{m}'" for m in STREAMING_MODELS)
    pm = ", ".join(f"'{m}'" for m in PROMPT_MODELS)
    return _ctes() + f""" SELECT sample_id, model,
CASE WHEN model IN ({sm}) THEN 'streaming' ELSE 'batch' END AS api_mode,
CASE WHEN model IN ({pm}) AND '{PROMPT}' <> '' THEN '{PROMPT}' END AS prompt FROM hyps"""


def agg_distinct_datasets(spark, sf):
    s = _scorable_samples(spark, sf).where(F.col("dataset") != "")
    return s.agg(F.array_sort(F.collect_set("dataset")).alias("datasets"),
                 F.count_distinct("dataset").alias("n_datasets"))


def sql_agg_distinct_datasets():
    return _ctes() + f""" SELECT list_sort(list_distinct(list(dataset))) AS datasets, count(DISTINCT dataset) AS n_datasets
FROM {SCORABLE} WHERE dataset <> ''"""


def sort_names(spark, sf):
    return _scorable_samples(spark, sf).select("dataset").distinct().orderBy("dataset")


def sql_sort_names():
    return _ctes() + f" SELECT DISTINCT dataset FROM {SCORABLE} ORDER BY dataset"


def set_union_all(spark, sf):
    """The quota-selected samples of every dataset, concatenated: their rows."""
    chosen = win_even_quota(spark, sf).select("sample_id")
    return _scorable_samples(spark, sf).join(chosen, "sample_id", "left_semi").select("sample_id", "dataset", "lang", "reference")


def sql_set_union_all():
    return _ctes(_quota_sql(QUOTA_TOTAL)) + f"""
SELECT s.sample_id, s.dataset, s.lang, s.reference FROM {SCORABLE} s JOIN ranked r USING (sample_id) JOIN reg ON reg.dataset = s.dataset
WHERE r.rn <= reg.quota"""


# --- per-sample text and scores -------------------------------------------------------

def str_normalize(spark, sf):
    s = fx.samples(spark, sf).select("sample_id", "reference")
    s = s.repartition(scoring_partitions(spark), "sample_id")
    return with_normalized(s, "reference", "ref").select("sample_id", F.col("ref_norm").alias("norm_ref"))


def sql_str_normalize():
    return _ctes(O.normalized_ctes("samples", "normed", "sample_id", "reference", "reference")) + \
        " SELECT sample_id, array_to_string(rt, ' ') AS norm_ref FROM normed"


def word_tables(spark, sf):
    """A stand-in for a caller's tables: words of the benchmark texts with six
    letters or more, spelled without their last one."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")
    words = read_table(spark, sf, "benchmark").select(word).distinct()
    return words.select("word", F.expr("substr(word, 1, length(word) - 1)").alias("replacement"))


def str_normalize_tables(spark, sf):
    """Normalised references with the words of a caller's table replaced."""
    s = fx.samples(spark, sf).select("sample_id", "reference").repartition(scoring_partitions(spark), "sample_id")
    tokens = with_normalized(s, "reference", "ref").select("sample_id", "ref_tokens")
    mapped = map_words(tokens, "sample_id", "ref_tokens", word_tables(spark, sf))
    return mapped.select("sample_id", F.array_join("ref_tokens", " ").alias("norm_ref"))


def sql_str_normalize_tables():
    return _ctes(O.normalized_ctes("samples", "normed", "sample_id", "reference", "reference"), """
words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark)""") + """
SELECT n.sample_id, coalesce(t.norm, '') AS norm_ref FROM normed n LEFT JOIN (
  SELECT sample_id, string_agg(CASE WHEN w.word IS NULL THEN token ELSE left(token, length(token) - 1) END, ' ' ORDER BY pos) AS norm
  FROM (SELECT sample_id, unnest(rt) AS token, generate_subscripts(rt, 1) AS pos FROM normed) LEFT JOIN words w ON w.word = token
  GROUP BY sample_id) t USING (sample_id)"""


def str_word_count(spark, sf):
    s = fx.samples(spark, sf)
    return s.select("sample_id", F.size(split_words(F.col("reference"))).alias("n_words"))


def sql_str_word_count():
    return _ctes() + f" SELECT sample_id, len({O.SPLIT_WORDS('reference')}) AS n_words FROM samples"


def str_wer(spark, sf):
    r = eval_results(spark, sf).where(F.col("error").isNull())
    return r.select("sample_id", "ref_words", "edits", F.round("wer", 9).alias("wer"))


def sql_str_wer():
    return O.with_recursive(*results_sql()) + \
        " SELECT sample_id, ref_words, edits, round(wer, 9) AS wer FROM results WHERE error IS NULL"


def agg_wer_overall(spark, sf):
    r = eval_results(spark, sf).where(F.col("error").isNull())
    return r.agg(F.count("*").alias("samples"), F.round(F.avg("wer") * 100, 9).alias("wer_pct"))


def sql_agg_wer_overall():
    return O.with_recursive(*results_sql()) + \
        " SELECT count(*) AS samples, round(avg(wer) * 100, 9) AS wer_pct FROM results WHERE error IS NULL"


def _wer_by_dataset(spark, sf):
    s = eval_summary(eval_results(spark, sf), latency_p=None).where(F.col("level") == "dataset")
    return s.select("dataset", F.col("scored").alias("samples"), "wer_pct")


def agg_wer_by_dataset(spark, sf):
    return _wer_by_dataset(spark, sf)


WER_BY_DS_SQL = """
SELECT dataset, samples, wer_pct FROM (
  SELECT dataset, count(*) AS samples, round(avg(wer) * 100, 9) AS wer_pct, count(*) OVER () AS nds
  FROM results WHERE error IS NULL AND dataset <> '' GROUP BY dataset) WHERE nds > 1"""


def sql_agg_wer_by_dataset():
    return O.with_recursive(*results_sql()) + WER_BY_DS_SQL


def str_pct_format(spark, sf):
    d = _wer_by_dataset(spark, sf)
    return d.select("dataset", F.concat(fmt_fixed(F.col("wer_pct"), 2), F.lit("%")).alias("wer_text"))


def sql_str_pct_format():
    return O.with_recursive(*results_sql()) + \
        f" SELECT dataset, {sql_fmt_fixed('wer_pct', 2)} || '%' AS wer_text FROM ({WER_BY_DS_SQL})"


def agg_summary_grouping_sets(spark, sf):
    s = eval_summary(eval_results(spark, sf), latency_p=None)
    return s.select("level", "dataset", "attempted", "scored", "skipped", "wer_pct")


def sql_agg_summary_grouping_sets():
    from .evaluation import summary_sql
    return O.with_recursive(*results_sql()) + \
        f" SELECT level, dataset, attempted, scored, skipped, wer_pct FROM ({summary_sql()})"


def agg_latency_stats(spark, sf):
    """Latency avg / P95 / min / max over every transcription (no WER)."""
    h = fx.hypotheses(spark, sf).withColumn("dataset", F.lit("all")).withColumn("wer", F.lit(0.0))
    s = eval_summary(h).where(F.col("level") == "overall")
    return s.select(*[f"{c}_{m}" for c in ("ttfb", "ttfs") for m in ("avg", "p95", "min", "max")])


def sql_agg_latency_stats():
    cols = []
    for c in ("ttfb", "ttfs"):
        cols += [f"round(avg({c}), 9) AS {c}_avg", f"round(quantile_cont({c}, 0.95), 9) AS {c}_p95",
                 f"round(min({c}), 9) AS {c}_min", f"round(max({c}), 9) AS {c}_max"]
    return _ctes() + f" SELECT {', '.join(cols)} FROM hyps WHERE error IS NULL"


def str_latency_line(spark, sf):
    h = fx.hypotheses(spark, sf)
    b = F.when(F.col("ttfb").isNotNull(), F.concat(F.lit("TTFB "), fmt_fixed(F.col("ttfb"), 2), F.lit("s")))
    s = F.when(F.col("ttfs").isNotNull(), F.concat(F.lit("TTFS "), fmt_fixed(F.col("ttfs"), 2), F.lit("s")))
    return h.select("sample_id", F.concat_ws(" | ", b, s).alias("latency"))


def sql_str_latency_line():
    b = f"CASE WHEN ttfb IS NOT NULL THEN 'TTFB ' || {sql_fmt_fixed('ttfb', 2)} || 's' END"
    s = f"CASE WHEN ttfs IS NOT NULL THEN 'TTFS ' || {sql_fmt_fixed('ttfs', 2)} || 's' END"
    return _ctes() + f" SELECT sample_id, concat_ws(' | ', {b}, {s}) AS latency FROM hyps"


QUERIES = {k: v for k, v in globals().items() if not k.startswith(("sql_", "_")) and callable(v)
           and k.split("_")[0] in ("src", "prj", "flt", "win", "lim", "join", "agg", "sort", "set", "str")}
ORACLE = {k: globals()["sql_" + k] for k in QUERIES if "sql_" + k in globals()}
