"""DuckDB SQL twins of the Spark queries (the correctness oracle).

Views ``documents``, ``benchmark``, ``events`` ... are registered by the
caller.  The fixture rules of ``scribeval.sources.fixtures`` are restated
here in DuckDB SQL; the normaliser uses the same fixed pattern tables.

Word edit distance in DuckDB: ``levenshtein`` counts bytes, so it is exact
only when every word maps to a one-byte character, i.e. for pairs with at
most 127 distinct words.  Larger pairs go through a recursive CTE over the
anti-diagonals of the edit-distance matrix (exact, slower).
"""

from __future__ import annotations

from ..functions.normalize import (
    WS,
    _sql_lit,
    duckdb_expand_words,
    duckdb_map_tokens,
    duckdb_normalize_string,
    duckdb_split_words,
)
from ..sources.fixtures import (
    BATCH_MODEL,
    BENCHMARK_DATASET,
    IGNORE_MARKER,
    LINE_ID_BASE,
    STREAMING_MODEL,
)
from ..sources.registry import EVALUATED, NO_LANGUAGE, OTHERS, TEST_EVERY

SPLIT_WORDS = duckdb_split_words


SPLIT_OF_DOCUMENT = f"CASE WHEN doc_id % {TEST_EVERY} = 0 THEN 'test' ELSE 'train' END"
DOCUMENT_DATASET = f"'documents-' || coalesce(lang, '{NO_LANGUAGE}') || '-' || {SPLIT_OF_DOCUMENT}"


def utterances_cte() -> str:
    return f"""
utter AS (
  SELECT (doc_id + 1) * {LINE_ID_BASE} + (pos - 1) AS sample_id, dataset, lang, line AS text
  FROM (
    SELECT doc_id, dataset, lang, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, {DOCUMENT_DATASET} AS dataset, lang, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS parts FROM documents)
  )
  UNION ALL
  SELECT -(item_id + 1) AS sample_id, '{BENCHMARK_DATASET}' AS dataset, 'en' AS lang, text FROM benchmark
)"""


def registry_cte(evaluated: bool = False) -> str:
    """``registry(dataset, position)``, in registry order."""
    others = [n for n, e in OTHERS.items() if not evaluated or e.path in EVALUATED]
    rest = " ".join(f"UNION ALL SELECT '{n}', n + {i} FROM doc_count" for i, n in enumerate(others))
    return f"""
doc_names AS (
  SELECT DISTINCT 'documents-' || coalesce(lang, '{NO_LANGUAGE}') || '-' || s AS dataset
  FROM documents, (SELECT unnest(['test', 'train']) AS s)
),
doc_count AS (SELECT count(*) AS n FROM doc_names),
registry AS (
  SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS position FROM doc_names {rest}
)"""


def samples_cte() -> str:
    return f"""
samples AS (
  SELECT sample_id, dataset, lang,
    CASE WHEN sample_id % 19 = 0 THEN '  {IGNORE_MARKER} '
         WHEN sample_id % 23 = 0 THEN '[INAUDIBLE] ' || text
         WHEN sample_id % 31 = 0 THEN ''
         ELSE text END AS reference
  FROM utter
)"""


def _edit_words(words: str) -> str:
    sub = "CASE WHEN (i - 1) % 11 = 5 THEN 'zz' ELSE w END"
    return (f"flatten(list_transform({words}, lambda w, i: CASE WHEN (i - 1) % 7 = 3 THEN []::VARCHAR[] "
            f"WHEN (i - 1) % 13 = 6 THEN [{sub}, 'uh'] ELSE [{sub}] END))")


def hypotheses_cte() -> str:
    hyp = f"array_to_string({_edit_words(SPLIT_WORDS('text'))}, ' ')"
    err = ("CASE WHEN sample_id % 17 = 0 THEN CASE WHEN sample_id % 34 = 0 THEN 'no spoken audio' "
           "ELSE 'server error 500' END END")
    model = f"CASE WHEN sample_id % 2 = 0 THEN '{STREAMING_MODEL}' ELSE '{BATCH_MODEL}' END"
    ttfs = "((abs(sample_id) % 50) / 10.0 + 0.5)::DOUBLE"
    return f"""
hyps AS (
  SELECT sample_id, model,
    CASE WHEN error IS NULL THEN CASE WHEN sample_id % 29 = 0 THEN '' ELSE hyp END END AS text,
    CASE WHEN error IS NULL AND model = '{STREAMING_MODEL}' THEN ttfs / 4 END AS ttfb,
    CASE WHEN error IS NULL THEN ttfs END AS ttfs,
    error
  FROM (SELECT sample_id, {model} AS model, {hyp} AS hyp, {err} AS error, {ttfs} AS ttfs FROM utter)
)"""


def not_unscorable(ref: str) -> str:
    marker = (f"coalesce(regexp_replace({ref}, {_sql_lit('^' + WS + '+|' + WS + '+$')}, '', 'g') "
              f"= '{IGNORE_MARKER}', false)")
    inaud = f"coalesce(contains(lower({ref}), 'inaudible'), false)"
    return f"NOT {marker} AND NOT {inaud}"


def normalized_ctes(src: str, out: str, cols: str, ref: str, hyp: str) -> str:
    """Two CTEs: ``{out}0`` with raw token lists, ``{out}`` with mapped
    tokens ``rt``/``ht`` and texts ``norm_ref``/``norm_hyp``."""
    return f"""
{out}00 AS (
  SELECT {cols}, {duckdb_expand_words(SPLIT_WORDS(duckdb_normalize_string(ref)))} AS rt0,
         {duckdb_expand_words(SPLIT_WORDS(duckdb_normalize_string(hyp)))} AS ht0
  FROM {src}
),
{out}0 AS (SELECT * FROM {out}00),
{out} AS (
  SELECT * EXCLUDE (rt0, ht0), {duckdb_map_tokens('rt0')} AS rt, {duckdb_map_tokens('ht0')} AS ht
  FROM {out}0
)"""


def edit_distance_ctes(src: str, out: str) -> str:
    """``{out}(key, dist)`` for every row of ``src(key, rt, ht)`` whose token
    lists are both non-empty."""
    big = 1000000000
    return f"""
{out}_enc AS (
  SELECT key, list_transform(rt, lambda w: list_position(v, w)) AS a,
         list_transform(ht, lambda w: list_position(v, w)) AS b, len(v) AS nv
  FROM (SELECT key, rt, ht, list_distinct(list_concat(rt, ht)) AS v FROM {src} WHERE len(rt) > 0 AND len(ht) > 0)
),
{out}_small AS (
  SELECT key, levenshtein(array_to_string(list_transform(a, lambda c: chr(c)), ''),
                          array_to_string(list_transform(b, lambda c: chr(c)), '')) AS dist
  FROM {out}_enc WHERE nv <= 127
),
{out}_dp(key, d, n, m, a, b, p2, p1) USING KEY (key) AS (
  SELECT key, 0, len(a), len(b), a, b,
         list_transform(range(len(a) + 1), lambda i: {big}),
         list_transform(range(len(a) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE {big} END)
  FROM {out}_enc WHERE nv > 127
  UNION
  SELECT key, d + 1, n, m, a, b, p1,
    list_transform(range(n + 1), lambda i:
      CASE WHEN d + 1 - i < 0 OR d + 1 - i > m THEN {big}
           WHEN i = 0 THEN d + 1
           WHEN d + 1 - i = 0 THEN i
           ELSE least(p1[i] + 1, p1[i + 1] + 1, p2[i] + CASE WHEN a[i] = b[d + 1 - i] THEN 0 ELSE 1 END) END)
  FROM {out}_dp WHERE d < n + m
),
{out} AS (
  SELECT key, p1[n + 1] AS dist FROM {out}_dp
  UNION ALL
  SELECT key, dist FROM {out}_small
)"""


def wer_expr(rt: str, ht: str, dist: str) -> str:
    return (f"CASE WHEN len({rt}) = 0 THEN 0.0 WHEN len({ht}) = 0 THEN 1.0 "
            f"ELSE {dist}::DOUBLE / len({rt}) END")


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes)
