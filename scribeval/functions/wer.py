"""Word error rate with Spark's built-in ``levenshtein``.

Word-level edit distance is reduced to character-level edit distance: the
words of one (reference, hypothesis) pair get codes, each word becomes one
Unicode code point above U+FFFF (so the surrogate range is never hit and
about a million distinct words per pair fit), and the two code-point
strings go to ``levenshtein``, which counts code points.  A word's code is its
hash where the pair's words have different ones (most pairs; a look at the
vocabulary tells), else its place in the vocabulary, which is a search for each
word.  Everything runs in the JVM; there is no Python worker and no per-row UDF.

Callers must put the token arrays (and the vocabulary) in their own
projection first, see ``with_word_distance``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_BASE = 0x10000
#: Codes from CODE_BASE on that have five hex digits.
CODES = 0x100000 - CODE_BASE


def _decoded(tokens: Column, code) -> Column:
    """One code point per token; all codes have five hex digits."""
    hexes = F.transform(tokens, lambda w: F.hex(code(w)))
    return F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(hexes, "000"))), "UTF-32")


def _hash_code(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(CODES)) + F.lit(CODE_BASE)


def _place_code(vocab: Column):
    return lambda w: F.array_position(vocab, w) + F.lit(CODE_BASE)


def with_word_distance(df: DataFrame, ref_tokens: str, hyp_tokens: str, out: str = "edits") -> DataFrame:
    """Adds ``out`` = word edit distance between two token-array columns."""
    vocab, alone = "_vocab", "_alone"
    r, h = F.col(ref_tokens), F.col(hyp_tokens)
    # identical token arrays (perfect transcripts) need no vocabulary or DP
    staged = df.withColumn(vocab, F.when(r != h, F.array_distinct(F.concat(r, h))))
    v = F.col(vocab)
    # a look at the hashes of the vocabulary: each word its own?
    staged = staged.withColumn(alone, F.size(F.array_distinct(F.transform(v, _hash_code))) == F.size(v))
    place = _place_code(v)
    dist = (
        F.when(F.size(r) == 0, F.size(h))
        .when(F.size(h) == 0, F.size(r))
        .when(r == h, F.lit(0))
        .when(F.col(alone), F.levenshtein(_decoded(r, _hash_code), _decoded(h, _hash_code)))
        .otherwise(F.levenshtein(_decoded(r, place), _decoded(h, place)))
    )
    return staged.withColumn(out, dist).drop(vocab, alone)


def wer_from(edits: Column, ref_tokens: Column, hyp_tokens: Column) -> Column:
    """Per-sample WER: empty reference -> 0.0, empty hypothesis -> 1.0,
    otherwise edits / reference words (may exceed 1)."""
    n = F.size(ref_tokens)
    return (
        F.when(n == 0, F.lit(0.0))
        .when(F.size(hyp_tokens) == 0, F.lit(1.0))
        .otherwise(edits.cast("double") / n)
    )
