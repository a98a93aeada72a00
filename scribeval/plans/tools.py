"""Data work of the assistant tools: step history, line search, catalogue,
dataset profile, text edits."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.normalize import WS
from ..functions.strings import (
    count_occurrences,
    ellipsis,
    first_nonblank,
    number_line,
    replace_first,
    strip_ws,
    template_fill,
)
from ..operators import textlines
from ..operators.search import query_words, search_texts, top_hits, window_blocks, window_lines, windows_of
from ..operators.textlines import read_lines, search_lines
from ..session import checkpoint_dir, materialize
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .corpus import doc_split

# --- fixed values -----------------------------------------------------------------
BOILERPLATE = ("Execution logs:", "Last output from code snippet:", "")
HEAD_LINES = 3
PRUNE_KEEP_STEPS = 5
PRUNE_CHARS = 200
PRUNED_MARK = "\n[pruned]"
MATCH_SEPARATOR = "\n\n---\n\n"
CATALOG_LIMIT = 10
SEARCH_WINDOWS = 15
# ---------------------------------------------------------------------------------

QUERY = "div the class"
CATALOG_SEARCHES = (("src1", "automatic-speech-recognition", "en"), ("SRC", "audio-classification", ""), ("zz'z", "automatic-speech-recognition", "fr"))
CATALOG_FOUND = "Found {n} dataset(s) for query='{query}':"
CATALOG_NONE = "No datasets found for query='{query}', task='{task}', language='{language}'."
EDIT_SPECS = (("the", "THE", False), ("the", "THE", True), ("Ouen", "OUEN", False))
COUNT_LITERAL = "the"
TEMPLATE = "{name}: {n} documents in {langs}"

LINE_BREAK = r"\r?\n"


def _sql_list(vals):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


# --- step history -------------------------------------------------------------------

def _kept_lines(text):
    lines = F.split(strip_ws(text), LINE_BREAK)
    return F.filter(lines, lambda ln: ~strip_ws(ln).isin(*BOILERPLATE))


def flt_boilerplate_lines(spark, sf):
    s = fx.steps(spark, sf)
    return s.select("conv_id", "turn", F.posexplode(_kept_lines(F.col("text"))).alias("pos", "line"))


def win_head_lines(spark, sf):
    s = fx.steps(spark, sf).select("conv_id", "turn", _kept_lines(F.col("text")).alias("kept"))
    more = F.greatest(F.size("kept") - HEAD_LINES, F.lit(0))
    return s.select("conv_id", "turn", F.array_join(F.slice("kept", 1, HEAD_LINES), "\n").alias("head"),
                    more.alias("more"),
                    F.when(more > 0, F.concat(F.lit("… +"), more.cast("string"), F.lit(" lines"))).alias("more_label"))


def _pruned(spark, sf):
    s = fx.steps(spark, sf)
    cur = s.groupBy("conv_id").agg(F.max("turn").alias("_current"))
    j = s.join(cur, "conv_id")
    prune = (F.col("turn") < F.col("_current") - PRUNE_KEEP_STEPS) & (F.length("text") > PRUNE_CHARS)
    return j.select("conv_id", "turn", "text", prune.alias("pruned"),
                    F.when(prune, F.concat(F.left("text", F.lit(PRUNE_CHARS)), F.lit(PRUNED_MARK)))
                    .otherwise(F.col("text")).alias("kept_text"))


def win_context_prune(spark, sf):
    return _pruned(spark, sf).select("conv_id", "turn", "pruned", "kept_text")


def flt_answer_nonempty(spark, sf):
    s = fx.steps(spark, sf).where(F.col("role") == "assistant")
    ok = F.coalesce(F.length(F.regexp_replace("text", WS, "")) > 0, F.lit(False))
    return s.select("conv_id", "turn", ok.alias("valid"))


def q_step_preview(spark, sf):
    p = _pruned(spark, sf).select("conv_id", "turn", "pruned", F.length("kept_text").alias("kept_chars"),
                                  _kept_lines(F.col("text")).alias("kept"))
    more = F.greatest(F.size("kept") - HEAD_LINES, F.lit(0))
    return p.select("conv_id", "turn", "pruned", "kept_chars",
                    F.array_join(F.slice("kept", 1, HEAD_LINES), "\n").alias("head"), more.alias("more"))


STEPS_SQL = """
steps AS (
  SELECT conv_id, turn, role,
         CASE WHEN turn % 3 = 0 THEN 'Execution logs:' || chr(10) || chr(10) || 'Last output from code snippet:' || chr(10) || text
              ELSE text END AS text
  FROM conversations
),
kept AS (
  SELECT conv_id, turn, role, text,
         list_filter(regexp_split_to_array(regexp_replace(text, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g'), '\\r?\\n'),
                     lambda l: regexp_replace(l, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g') NOT IN (""" + _sql_list(BOILERPLATE) + """)) AS kept
  FROM steps
),
pruned AS (
  SELECT conv_id, turn, text, kept,
         turn < max(turn) OVER (PARTITION BY conv_id) - """ + str(PRUNE_KEEP_STEPS) + """ AND length(text) > """ + str(PRUNE_CHARS) + """ AS pruned
  FROM kept
)"""


def _steps(tail):
    return "WITH " + STEPS_SQL + tail


def sql_flt_boilerplate_lines():
    return _steps(""" SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, line FROM (
SELECT conv_id, turn, unnest(kept) AS line, generate_subscripts(kept, 1) AS pos FROM kept)""")


def sql_win_head_lines():
    return _steps(""" SELECT conv_id, turn, array_to_string(kept[1:3], chr(10)) AS head,
greatest(len(kept) - 3, 0) AS more,
CASE WHEN len(kept) > 3 THEN '… +' || CAST(len(kept) - 3 AS VARCHAR) || ' lines' END AS more_label FROM kept""")


def sql_win_context_prune():
    return _steps(f""" SELECT conv_id, turn, pruned,
CASE WHEN pruned THEN left(text, {PRUNE_CHARS}) || chr(10) || '[pruned]' ELSE text END AS kept_text FROM pruned""")


def sql_flt_answer_nonempty():
    return _steps(""" SELECT conv_id, turn, coalesce(length(regexp_replace(text, '[\\t\\n\\f\\r ]', '', 'g')) > 0, false) AS valid
FROM steps WHERE role = 'assistant'""")


def sql_q_step_preview():
    return _steps(f""" SELECT conv_id, turn, pruned,
length(CASE WHEN pruned THEN left(text, {PRUNE_CHARS}) || chr(10) || '[pruned]' ELSE text END) AS kept_chars,
array_to_string(kept[1:3], chr(10)) AS head, greatest(len(kept) - 3, 0) AS more FROM pruned""")


# --- line search ----------------------------------------------------------------------

def src_lines(spark, sf):
    return fx.text_lines(spark, sf)


def str_number_lines(spark, sf):
    ln = fx.text_lines(spark, sf)
    return ln.select("doc_id", "line_no", number_line(F.col("line_no"), F.col("line")).alias("numbered"))


def _found(spark, sf):
    return search_texts(fx.searchable_texts(spark, sf), QUERY, limit=SEARCH_WINDOWS)


def str_keyword_score(spark, sf):
    return top_hits(_found(spark, sf)).select("doc_id", "line_no", "score")


def top_line_hits(spark, sf):
    return top_hits(_found(spark, sf), limit=SEARCH_WINDOWS)


def win_greedy_windows(spark, sf):
    return windows_of(_found(spark, sf))


def join_line_window(spark, sf):
    return window_lines(_found(spark, sf))


def set_covered_lines(spark, sf):
    """The windows of a text do overlap at their edges; its covered lines are
    merged inside its row."""
    covered = F.array_distinct(F.flatten(F.transform(
        "windows", lambda w: F.sequence(w.start, w.end - 1))))
    return _found(spark, sf).select("doc_id", F.explode(covered).alias("line_no"))


def q_line_search(spark, sf):
    found = _found(spark, sf).withColumn("n_matches", F.size("windows").cast("long"))
    header = F.concat(F.lit("Found "), F.col("n_matches").cast("string"), F.lit(f" match(es) for '{QUERY}':\n\n"))
    text = F.when(F.col("n_matches") > 0, F.concat(header, window_blocks(MATCH_SEPARATOR))).otherwise(
        F.lit(f"No matches for '{QUERY}'."))
    return found.select("doc_id", "n_matches", F.col("total_hits").cast("long").alias("total_hits"), text.alias("result"))


#: Bytes of text that one task of ``text_files`` sorts and writes, about.
TEXT_PART = 64 << 20


def text_files(spark, sf) -> str:
    """A stand-in for texts larger than a row: the documents of each source,
    in id order, as one text of several part files."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/text_files/{uuid.uuid4().hex}"
    docs = read_table(spark, sf, "documents").select(
        F.coalesce("text", F.lit("")).alias("value"), F.coalesce("source", F.lit("none")).alias("text"), "doc_id")
    # as many parts as the texts fill, so that a task's share does not grow with them
    size = docs.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    docs.repartitionByRange(max(4, -(-size // TEXT_PART)), "text", "doc_id").sortWithinPartitions("text", "doc_id").drop("doc_id").write.partitionBy("text").text(path)
    return path


def src_text_files(spark, sf):
    """Numbered lines of texts read split by split."""
    return read_lines(spark, text_files(spark, sf)).select("text", "line_no", "line")


def join_text_windows(spark, sf):
    """Line search on such texts: the lines of the kept windows, by a range join."""
    lines = read_lines(spark, text_files(spark, sf))
    return textlines.window_lines(lines, search_lines(lines, QUERY, SEARCH_WINDOWS))


def _words_sql():
    return " + ".join(f"CAST(contains(lower(line), '{w}') AS INTEGER)" for w in query_words(QUERY))


LINES_SQL = """
lines AS (
  SELECT doc_id, CAST(pos - 1 AS INTEGER) AS line_no, line FROM (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (
      SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM (
        SELECT page_id AS doc_id, regexp_split_to_array(coalesce(html, ''), '\\r?\\n') AS parts FROM pages
        UNION ALL
        SELECT -(doc_id + 1) AS doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS parts FROM documents)))
),
scored AS (SELECT doc_id, line_no, SCORE AS score FROM lines),
hits AS (
  SELECT doc_id, line_no, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rk
  FROM scored WHERE score > 0
),
nl AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id),
walk(doc_id, rk, kept) AS (
  SELECT doc_id, 1, [line_no] FROM hits WHERE rk = 1
  UNION ALL
  SELECT w.doc_id, w.rk + 1,
         CASE WHEN list_bool_or(list_transform(w.kept, lambda s: h.line_no >= s - 2 AND h.line_no < s + 10))
              THEN w.kept ELSE list_append(w.kept, h.line_no) END
  FROM walk w JOIN hits h ON h.doc_id = w.doc_id AND h.rk = w.rk + 1
  WHERE len(w.kept) < MAXW
),
final AS (SELECT doc_id, arg_max(kept, rk) AS kept FROM walk GROUP BY doc_id),
windows AS (
  SELECT f.doc_id, CAST(pos - 1 AS INTEGER) AS window_no, CAST(hit AS INTEGER) AS hit_line,
         CAST(greatest(0, hit - 2) AS INTEGER) AS start, CAST(least(nl.n_lines, hit + 10) AS INTEGER) AS "end"
  FROM (SELECT doc_id, unnest(kept) AS hit, generate_subscripts(kept, 1) AS pos FROM final) f JOIN nl USING (doc_id)
),
wlines AS (
  SELECT w.doc_id, w.window_no, l.line_no, l.line FROM windows w JOIN lines l
  ON l.doc_id = w.doc_id AND l.line_no >= w.start AND l.line_no < w."end"
)"""


def _lines(tail):
    return "WITH RECURSIVE " + LINES_SQL.replace("SCORE", _words_sql()).replace("MAXW", str(SEARCH_WINDOWS)) + tail


TEXT_LINES_SQL = """
lines AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY d, pos) - 1 AS line_no, line FROM (
    SELECT doc_id, d, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (
      SELECT coalesce(source, 'none') AS doc_id, doc_id AS d, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS parts FROM documents))
),
scored"""


def _text_lines(tail):
    rest = LINES_SQL[LINES_SQL.index("\nscored") + len("\nscored"):]
    return "WITH RECURSIVE " + (TEXT_LINES_SQL + rest).replace("SCORE", _words_sql()).replace("MAXW", str(SEARCH_WINDOWS)) + tail


def sql_src_text_files():
    return _text_lines(" SELECT doc_id AS text, line_no, line FROM lines")


def sql_join_text_windows():
    return _text_lines(" SELECT doc_id AS text, window_no, line_no, line FROM wlines")


def sql_src_lines():
    return _lines(" SELECT doc_id, line_no, line FROM lines")


def sql_str_number_lines():
    return _lines(" SELECT doc_id, line_no, printf('%4d | %s', line_no + 1, line) AS numbered FROM lines")


def sql_str_keyword_score():
    return _lines(" SELECT doc_id, line_no, score FROM scored WHERE score > 0")


def sql_top_line_hits():
    return _lines(f" SELECT doc_id, line_no, score, CAST(rk AS INTEGER) AS rank, "
                  f"CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_hits FROM hits QUALIFY rk <= {SEARCH_WINDOWS}")


def sql_win_greedy_windows():
    return _lines(' SELECT doc_id, window_no, hit_line, start, "end" FROM windows')


def sql_join_line_window():
    return _lines(" SELECT doc_id, window_no, line_no, line FROM wlines")


def sql_set_covered_lines():
    return _lines(" SELECT DISTINCT doc_id, line_no FROM wlines")


def sql_q_line_search():
    return _lines(f""", found AS (SELECT doc_id, count(*) AS n_matches,
'Found ' || CAST(count(*) AS VARCHAR) || ' match(es) for ''{QUERY}'':' || chr(10) || chr(10) ||
string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY window_no) AS result
FROM (SELECT doc_id, window_no, string_agg(line, chr(10) ORDER BY line_no) AS block FROM wlines GROUP BY doc_id, window_no)
GROUP BY doc_id),
every AS (SELECT page_id AS doc_id FROM pages UNION ALL SELECT -(doc_id + 1) FROM documents),
n AS (SELECT doc_id, count(*) AS k FROM hits GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(k, 0) AS total_hits,
coalesce(result, 'No matches for ''{QUERY}''.') AS result
FROM every e LEFT JOIN found f USING (doc_id) LEFT JOIN n USING (doc_id)""")


# --- catalogue and dataset profile ------------------------------------------------------

def _cat(spark, sf):
    c = fx.catalog(spark, sf)
    desc = first_nonblank(F.col("description"), F.col("card_description"), F.col("pretty_name"))
    return c.withColumn("desc", desc)


def _catalog_line():
    langs = F.when(F.size("languages") > 0, F.array_join("languages", ", ")).otherwise(F.lit("n/a"))
    return F.concat(F.lit("- **"), F.col("id"), F.lit("**  ("), F.format_number(F.col("downloads"), 0),
                    F.lit(" downloads, langs: "), langs, F.lit(")"))


def src_catalog(spark, sf):
    return fx.catalog(spark, sf).select("id", "downloads", "description", "card_description", "pretty_name",
                                        "languages")


def top_downloads(spark, sf):
    return fx.catalog(spark, sf).orderBy(F.desc("downloads"), "id").limit(CATALOG_LIMIT).select("id", "downloads")


def str_desc_fallback(spark, sf):
    return _cat(spark, sf).select("id", "desc")


def str_ellipsis(spark, sf):
    return _cat(spark, sf).select("id", ellipsis(F.col("desc")).alias("short_desc"))


def str_catalog_line(spark, sf):
    return _cat(spark, sf).select("id", _catalog_line().alias("line"))


def search_catalog(catalog, query: str, task: str = "automatic-speech-recognition", language: str = "", limit: int = CATALOG_LIMIT):
    """(line_no, line) of one search: a header, then two lines for each of the
    most downloaded entries whose id holds the query (one where there is no
    description), or the one line that nothing was found.  Empty task or
    language: any."""
    c = catalog.where(F.lower("id").contains(query.lower()))
    if task:
        c = c.where(F.col("task") == task)
    if language:
        c = c.where(F.array_contains("languages", language))
    # at most ``limit`` rows from here on
    top = c.orderBy(F.desc("downloads"), "id").limit(limit)
    top = top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("downloads"), "id")))
    desc = F.when(F.col("desc") != "", F.concat(F.lit("  "), ellipsis(F.col("desc"))))
    found = top.select(F.explode(F.array(F.struct((F.col("n") * 2).alias("line_no"), _catalog_line().alias("line")),
                                         F.struct((F.col("n") * 2 + 1).alias("line_no"), desc.alias("line")))).alias("l")).select("l.*").where("line IS NOT NULL")
    head, rest = CATALOG_FOUND.split("{n}")
    none = CATALOG_NONE.format(query=query, task=task, language=language)
    header = top.agg(F.count("*").alias("k")).select(F.lit(1).alias("line_no"), F.when(F.col("k") == 0, F.lit(none)).otherwise(
        F.concat(F.lit(head), F.col("k").cast("string"), F.lit(rest.format(query=query)))).alias("line"))
    return header.unionByName(found)


def q_catalog_search(spark, sf):
    """Three searches: with task and language, by task alone, and one that
    finds nothing."""
    out, catalog = None, materialize(_cat(spark, sf), "catalog")
    for i, (query, task, language) in enumerate(CATALOG_SEARCHES):
        one = search_catalog(catalog, query, task, language).select(F.lit(i).alias("search"), "line_no", "line")
        out = one if out is None else out.unionByName(one)
    return out


def str_template_fill(spark, sf):
    c = fx.catalog(spark, sf)
    return c.select("id", template_fill(TEMPLATE, {"name": F.col("id"), "n": F.col("n_docs"),
                                                   "langs": F.array_join("languages", ", ")}).alias("text"))


def agg_split_counts(spark, sf):
    d = doc_split(spark, sf)
    return d.groupBy(F.col("source").alias("dataset_id"), F.col("lang").alias("config"), "split").agg(
        F.count("*").alias("num_examples"))


def join_config_info(spark, sf):
    d = doc_split(spark, sf)
    configs = d.select(F.col("source").alias("dataset_id"), F.col("lang").alias("config")).distinct()
    info = agg_split_counts(spark, sf)
    return configs.join(info, ["dataset_id", "config"], "left").select(
        "dataset_id", "config", "split", "num_examples")


def q_dataset_profile(spark, sf):
    """Per dataset: configs, columns (from the table schema) and split sizes."""
    cols = ", ".join(read_table(spark, sf, "documents").columns)
    counts = agg_split_counts(spark, sf)
    lines = counts.select("dataset_id", "config", F.concat(
        F.lit("  Split `"), F.col("split"), F.lit("`: "), F.format_number(F.col("num_examples"), 0),
        F.lit(" examples")).alias("split_line"), "split")
    per_cfg = lines.groupBy("dataset_id", "config").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "split_line"))),
                                 lambda x: x.split_line), "\n").alias("splits"))
    return per_cfg.select("dataset_id", "config", F.lit(cols).alias("columns"), "splits")


CAT_SQL = """
cat AS (
  SELECT source AS id, sum(n_chars) AS downloads, list_sort(list_distinct(list(lang))) AS languages,
         arg_min(text, doc_id) AS first_text, count(*) AS n_docs
  FROM documents GROUP BY source
),
cat2 AS (
  SELECT id, downloads,
         CASE WHEN CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) % 2 = 0 THEN '' ELSE 'Speech-like corpus ' || id END AS description,
         CASE WHEN CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) % 3 = 0 THEN NULL ELSE first_text END AS card_description,
         upper(id) AS pretty_name, languages, n_docs,
         CASE WHEN CAST(regexp_extract(id, '(\\d+)$', 1) AS INTEGER) % 4 = 3 THEN 'audio-classification' ELSE 'automatic-speech-recognition' END AS task
  FROM cat
),
cat3 AS (
  SELECT *, coalesce(nullif(description, ''), nullif(card_description, ''), nullif(pretty_name, ''), '') AS "desc",
         '- **' || id || '**  (' || format('{:,}', downloads) || ' downloads, langs: ' ||
         CASE WHEN len(languages) > 0 THEN array_to_string(languages, ', ') ELSE 'n/a' END || ')' AS line
  FROM cat2
),
split AS (
  SELECT d.doc_id, d.source, d.lang, CASE WHEN d.doc_id IN (SELECT doc_id FROM labels) THEN 'test' ELSE 'train' END AS split
  FROM documents d
),
counts AS (SELECT source AS dataset_id, lang AS config, split, count(*) AS num_examples FROM split GROUP BY ALL)"""


def _c(tail):
    return "WITH " + CAT_SQL + tail


def _ellipsis_sql(x):
    return f"CASE WHEN length({x}) > 120 THEN left({x}, 120) || '…' ELSE {x} END"


def sql_src_catalog():
    return _c(" SELECT id, downloads, description, card_description, pretty_name, languages FROM cat2")


def sql_top_downloads():
    return _c(f" SELECT id, downloads FROM cat2 ORDER BY downloads DESC, id LIMIT {CATALOG_LIMIT}")


def sql_str_desc_fallback():
    return _c(' SELECT id, "desc" FROM cat3')


def sql_str_ellipsis():
    return _c(f' SELECT id, {_ellipsis_sql(chr(34) + "desc" + chr(34))} AS short_desc FROM cat3')


def sql_str_catalog_line():
    return _c(" SELECT id, line FROM cat3")


def sql_q_catalog_search():
    d, parts = '"desc"', []
    for i, (query, task, language) in enumerate(CATALOG_SEARCHES):
        where = [f"contains(lower(id), '{query.lower().replace(chr(39), chr(39) * 2)}')"] + ([f"task = '{task}'"] if task else []) + (
            [f"list_contains(languages, '{language}')"] if language else [])
        none = CATALOG_NONE.format(query=query, task=task, language=language).replace("'", "''")
        head, rest = CATALOG_FOUND.format(n="{n}", query=query).replace("'", "''").split("{n}")
        top = f"""(SELECT *, row_number() OVER (ORDER BY downloads DESC, id) AS n FROM cat3 WHERE {' AND '.join(where)} QUALIFY n <= {CATALOG_LIMIT})"""
        parts += [f"SELECT {i} AS search, 1 AS line_no, CASE WHEN count(*) = 0 THEN '{none}' ELSE '{head}' || CAST(count(*) AS VARCHAR) || '{rest}' END AS line FROM {top}",
                  f"SELECT {i}, n * 2, line FROM {top}", f"SELECT {i}, n * 2 + 1, '  ' || {_ellipsis_sql(d)} FROM {top} WHERE {d} <> ''"]
    return _c(" SELECT search, CAST(line_no AS INTEGER) AS line_no, line FROM (" + " UNION ALL ".join(parts) + ")")


def sql_str_template_fill():
    return _c(""" SELECT id, id || ': ' || CAST(n_docs AS VARCHAR) || ' documents in ' || array_to_string(languages, ', ') AS text
FROM cat2""")


def sql_agg_split_counts():
    return _c(" SELECT dataset_id, config, split, num_examples FROM counts")


def sql_join_config_info():
    return _c(""" SELECT c.dataset_id, c.config, i.split, i.num_examples
FROM (SELECT DISTINCT source AS dataset_id, lang AS config FROM documents) c
LEFT JOIN counts i USING (dataset_id, config)""")


def sql_q_dataset_profile():
    return _c(""" SELECT dataset_id, config, 'doc_id, text, lang, source, n_chars' AS columns,
string_agg('  Split `' || split || '`: ' || format('{:,}', num_examples) || ' examples', chr(10) ORDER BY split) AS splits
FROM counts GROUP BY dataset_id, config""")


# --- text edits -------------------------------------------------------------------------

def str_count_occurrences(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", count_occurrences(F.col("text"), F.lit(COUNT_LITERAL)).alias("n"))


def str_bulk_replace(spark, sf):
    """Every document through every edit spec: status and edited text digest."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    specs = F.array(*[F.struct(F.lit(i).alias("spec_no"), F.lit(o).alias("old"), F.lit(n).alias("new"),
                               F.lit(a).alias("replace_all")) for i, (o, n, a) in enumerate(EDIT_SPECS)])
    x = d.select("doc_id", "text", F.explode(specs).alias("s")).select("doc_id", "text", "s.*")
    cnt = count_occurrences(F.col("text"), F.col("old"))
    status = (F.when(cnt == 0, F.lit("not_found"))
              .when(~F.col("replace_all") & (cnt > 1), F.concat(F.lit("ambiguous("), cnt.cast("string"), F.lit(")")))
              .otherwise(F.concat(F.lit("edited("), cnt.cast("string"), F.lit(")"))))
    edited = F.when(cnt == 0, F.col("text")).when(~F.col("replace_all") & (cnt > 1), F.col("text")).when(
        F.col("replace_all"), F.replace(F.col("text"), F.col("old"), F.col("new"))).otherwise(
        replace_first(F.col("text"), F.col("old"), F.col("new")))
    return x.select("doc_id", "spec_no", cnt.alias("count"), status.alias("status"), F.md5(edited).alias("digest"))


def set_merge_lines(spark, sf):
    """Union of two line lists, trimmed, blanks dropped, de-duplicated, sorted."""
    a = read_table(spark, sf, "conversations").select(F.explode(F.split("text", LINE_BREAK)).alias("l"))
    b = read_table(spark, sf, "benchmark").select(F.explode(F.split("text", LINE_BREAK)).alias("l"))
    u = a.unionByName(b).select(strip_ws(F.col("l")).alias("line")).where(F.col("line") != "")
    return u.distinct().orderBy("line")


def sql_str_count_occurrences():
    return f""" SELECT doc_id, CAST((length(text) - length(replace(text, '{COUNT_LITERAL}', ''))) / length('{COUNT_LITERAL}') AS BIGINT) AS n
FROM documents"""


def sql_str_bulk_replace():
    specs = " UNION ALL ".join(f"SELECT {i} AS spec_no, '{o}' AS old, '{n}' AS new, {str(a).upper()} AS replace_all"
                               for i, (o, n, a) in enumerate(EDIT_SPECS))
    cnt = "CAST((length(text) - length(replace(text, old, ''))) // length(old) AS BIGINT)"
    first = "left(text, strpos(text, old) - 1) || new || substr(text, strpos(text, old) + length(old))"
    return f""" SELECT doc_id, spec_no, cnt AS count,
CASE WHEN cnt = 0 THEN 'not_found' WHEN NOT replace_all AND cnt > 1 THEN 'ambiguous(' || CAST(cnt AS VARCHAR) || ')'
     ELSE 'edited(' || CAST(cnt AS VARCHAR) || ')' END AS status,
md5(CASE WHEN cnt = 0 THEN text WHEN NOT replace_all AND cnt > 1 THEN text WHEN replace_all THEN replace(text, old, new)
         ELSE {first} END) AS digest
FROM (SELECT d.doc_id, d.text, s.*, {cnt} AS cnt FROM documents d CROSS JOIN ({specs}) s)"""


def sql_set_merge_lines():
    strip = "regexp_replace(l, '^[\\t\\n\\f\\r ]+|[\\t\\n\\f\\r ]+$', '', 'g')"
    return f""" SELECT DISTINCT {strip} AS line FROM (
SELECT unnest(regexp_split_to_array(text, '\\r?\\n')) AS l FROM conversations
UNION ALL SELECT unnest(regexp_split_to_array(text, '\\r?\\n')) AS l FROM benchmark)
WHERE {strip} <> '' ORDER BY line"""


_KEYS = (
    "flt_boilerplate_lines", "win_head_lines", "win_context_prune", "flt_answer_nonempty", "q_step_preview",
    "src_lines", "src_text_files", "join_text_windows", "str_number_lines", "str_keyword_score", "top_line_hits", "win_greedy_windows",
    "join_line_window", "set_covered_lines", "q_line_search",
    "src_catalog", "top_downloads", "str_desc_fallback", "str_ellipsis", "str_catalog_line", "q_catalog_search",
    "str_template_fill", "agg_split_counts", "join_config_info", "q_dataset_profile",
    "str_count_occurrences", "str_bulk_replace", "set_merge_lines",
)
QUERIES = {k: globals()[k] for k in _KEYS}
ORACLE = {k: globals()["sql_" + k] for k in _KEYS}
