"""Word tables of any size, given as DataFrames, applied to token arrays.

A table maps words to replacements (spellings, numbers, names; several words
or none are allowed).  Small literal tables are looked up inside the row
(``functions/normalize.py``); a table from outside is joined:

1. every token is a row (key, place, word) and meets the table by its word;
   only the few that the table knows come through.  A table up to
   ``BROADCAST_ROWS`` rows is broadcast, whatever it holds; a larger one is
   joined by a shuffle in which each word is dealt to ``SALTS`` places, as a
   frequent word may be a large part of all tokens;
2. the found replacements of a row are gathered by its key in the order of
   their places, and the array is put together again from the stretches
   between them: the work is linear in the row's length.

Rows that the table does not touch pass with their arrays as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BROADCAST_ROWS = 50_000
SALTS = 16


def word_table(table: DataFrame, word_col: str = "word", to_col: str = "replacement") -> DataFrame:
    """One row per word (the smallest replacement where several are given);
    rows with a null are left out.  Written once, so that its size is known."""
    rows = table.select(F.col(f"`{word_col}`").cast("string").alias("_word"), F.col(f"`{to_col}`").cast("string").alias("_to"))
    return materialize(rows.where("_word IS NOT NULL AND _to IS NOT NULL").groupBy("_word").agg(F.min("_to").alias("_to")), "words")


def _known(tokens: DataFrame, table: DataFrame, broadcast_rows: int) -> DataFrame:
    if table.count() <= broadcast_rows:
        return tokens.join(F.broadcast(table), "_word")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tokens.withColumn("_salt", F.pmod(F.xxhash64("_key", "_at"), F.lit(SALTS)).cast("int")).join(salted, ["_word", "_salt"])


def map_words(df: DataFrame, key_col: str, tokens_col: str, table: DataFrame, out: str | None = None,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the words of the array ``tokens_col`` replaced by ``table``
    (word, replacement); ``key_col`` names each row.  Rows with a null key or
    array keep their arrays."""
    key, tokens = F.col(f"`{key_col}`"), F.col(f"`{tokens_col}`")
    # the outer form: the other one brings a filter on the array, which the
    # optimizer would push, with all that makes the array, below its stages
    each = df.select(key.alias("_key"), F.posexplode_outer(tokens).alias("_at", "_word")).where("_key IS NOT NULL AND _word IS NOT NULL")
    hits = _known(each, word_table(table), broadcast_rows).select("_key", F.struct("_at", "_to").alias("_hit"))
    found = hits.groupBy("_key").agg(F.array_sort(F.collect_list("_hit")).alias("_hits"))
    joined = df.join(found, key == F.col("_key"), "left")
    hit = F.col("_hits")

    def stretch(h, i):
        """The tokens since the hit before, and the replacement's words."""
        begin = F.when(i > 0, F.get(hit, i - 1)["_at"] + 1).otherwise(F.lit(0))
        words = F.filter(F.split(h["_to"], " "), lambda w: w != "")
        return F.concat(F.slice(tokens, begin + 1, h["_at"] - begin), words)
    last = F.element_at(hit, -1)["_at"]
    rest = F.slice(tokens, last + 2, F.greatest(F.size(tokens) - last - 1, F.lit(0)))
    mapped = F.concat(F.flatten(F.transform(hit, stretch)), rest)
    value = F.when(hit.isNull(), tokens).otherwise(mapped).alias(out or tokens_col)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != (out or tokens_col)], value)
