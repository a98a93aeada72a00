"""Transcript scoring: normalise both sides once, then WER.

Each stage is its own projection so that the regex chain runs once per text
(``map_tokens`` and the WER encoder refer to their inputs several times; a
staged column keeps Catalyst from copying the chain into lambdas).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import SPELLINGS, normalized_words, with_mapped_tokens
from ..functions.wer import wer_from, with_word_distance


def with_normalized(df: DataFrame, src: str, prefix: str, spellings=SPELLINGS) -> DataFrame:
    """Adds ``{prefix}_tokens`` (normalised words) and ``{prefix}_norm`` (text)."""
    raw = f"_{prefix}_raw_tokens"
    out = with_mapped_tokens(normalized_words(df, src, raw), raw, f"{prefix}_tokens", spellings).drop(raw)
    return out.withColumn(f"{prefix}_norm", F.array_join(F.col(f"{prefix}_tokens"), " "))


def score_wer(df: DataFrame, ref: str = "reference", hyp: str = "text",
              keep_tokens: bool = False, spellings=SPELLINGS) -> DataFrame:
    """Adds norm_ref, norm_hyp, ref_words, edits and wer to ``df``."""
    d = with_normalized(df, ref, "ref", spellings)
    d = with_normalized(d, hyp, "hyp", spellings)
    d = with_word_distance(d, "ref_tokens", "hyp_tokens", "edits")
    d = d.withColumn("ref_words", F.size("ref_tokens")).withColumn(
        "wer", wer_from(F.col("edits"), F.col("ref_tokens"), F.col("hyp_tokens")))
    d = d.withColumnRenamed("ref_norm", "norm_ref").withColumnRenamed("hyp_norm", "norm_hyp")
    if not keep_tokens:
        d = d.drop("ref_tokens", "hyp_tokens")
    return d
