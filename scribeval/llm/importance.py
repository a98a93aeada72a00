"""Importance resampling towards a target distribution (hashed n-grams).

Every text becomes a bag of n-grams of its words in ``BUCKETS`` hash buckets.
A bucket's gain is the scaled log ratio of its smoothed share in the target
texts and in the raw texts; a document's weight is the sum of its features'
gains, and with Gumbel noise (from a hash of the id, so reruns agree) the
highest scores are a draw without replacement in proportion to the weights.

1. Counting: each task counts its buckets in one array and sends one row per
   bucket that occurs; Spark adds them up (``BUCKETS`` rows whatever the
   input).
2. Scoring: the gains travel as one array of fixed size; a document's weight
   is a sum of array look-ups.  Scores are written once as a table, so every
   later job reads the same rows and a lost executor repeats no scoring.
3. Drawing: the cutoff is found by numeric bisection.  Each step is a job
   that counts exactly, over the written scores, how many rows lie at or
   before some points between the two bounds (several points a job, so that
   few jobs are needed), until the bounds meet; rows that tie at the cutoff
   are settled by a bisection over their ids, and rows that share the id too
   by a bisection over their places in the table.  Nothing is sorted for
   this and nothing is collected but the counts.
4. Ranks: only the drawn rows are range-partitioned and numbered.

N-gram hashes are CRC-32 values.  CRC-32 is linear: the value of a joined
text follows from the values of its parts and the second part's length, so
each distinct word of a slice is hashed once and n-grams are combined with
table look-ups.

Edge cases: null, empty and wordless texts have no features and weight 0; an
empty target or corpus counts as all zeros; a null id is hashed as an empty
text and loses ties; repeated rows are rows each (tied ones are drawn in the
order of the written table); no rows or a draw of nothing give null ranks.
Memory follows the slice, also for very long texts.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import range_row_number
from ..session import materialize
from .words import ASCII_LOWER, text_buffer, text_slices

BUCKETS = 10_000
SLICE_BYTES = 1 << 20
POINTS_A_JOB = 15
#: Scores are at least 0 here and below 2**63; ids are any longs.
LAST_ID = (1 << 63) - 1

#: Word bytes after folding: digits, a-z, and all bytes outside ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """``table[n, k, b]``: CRC register ``b << 8k`` after n zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    step = byte.copy()
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    table = np.empty((256, 4, 256), dtype=np.uint32)
    now = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    for n in range(256):
        table[n] = now
        now = step[now & 255] ^ (now >> np.uint32(8))
    return table


def _shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC registers after ``length`` zero bytes each."""
    table = _shifts()

    def by(x, n):
        return (table[n, 0, x & 255] ^ table[n, 1, (x >> np.uint32(8)) & 255]
                ^ table[n, 2, (x >> np.uint32(16)) & 255] ^ table[n, 3, x >> np.uint32(24)])
    out, more = by(crc, length & 255), length >> 8
    while len(left := np.flatnonzero(more)):  # 256 bytes at a time
        out[left] = by(by(out[left], 255), 1)
        more[left] -= 1
    return out


def _word_crcs(letters: np.ndarray, sizes: np.ndarray):
    """(crc of the word, crc of a blank and the word, length with the blank)
    of words laid end to end; each distinct word is hashed once."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())])
    coded = words.dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    n, blank = len(kinds), zlib.crc32(b" ")
    alone = np.fromiter((zlib.crc32(w) for w in kinds), np.uint32, n)
    after = np.fromiter((zlib.crc32(w, blank) for w in kinds), np.uint32, n)
    code = coded.indices.to_numpy()
    return alone[code], after[code], sizes + 1


def _pieces(folded: np.ndarray, offsets: np.ndarray):
    """(first text, last + 1, first byte, last + 1) of slices: whole texts, or
    parts of a long text that end between words."""
    for lo, hi in text_slices(offsets, SLICE_BYTES):
        at, end = int(offsets[lo]), int(offsets[hi])
        while end - at > 2 * SLICE_BYTES:
            gaps = np.flatnonzero(~_WORD[folded[at + SLICE_BYTES:min(end, at + 2 * SLICE_BYTES)]])
            if len(gaps):
                stop = at + SLICE_BYTES + int(gaps[0])
            else:  # a word longer than a slice stays whole
                wide = at + 2 * SLICE_BYTES
                while wide < end and _WORD[folded[wide]]:
                    wide += 1
                stop = wide
            yield lo, hi, at, stop
            at = stop
        yield lo, hi, at, end


def features(column, most: int = 3):
    """For slices of the texts: (text, bucket) of every run of 1 to ``most``
    words, and the number of words of each text of the slice:
    ``(texts, buckets, first text, words)``."""
    buf, offsets = text_buffer(column)
    folded = ASCII_LOWER[buf]
    carried: list[np.ndarray] | None = None  # the last words of a text that goes on
    for lo, hi, at, end in _pieces(folded, offsets):
        inside = _WORD[folded[at:end]]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        bounds = offsets[lo:hi + 1] - at
        heads = bounds[:-1][(bounds[:-1] >= 0) & (bounds[:-1] < bounds[1:])]
        opens[heads] |= inside[heads]
        inner = heads[heads > 0]
        closes[inner - 1] |= inside[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        doc = np.searchsorted(bounds[1:], starts, side="right")
        words = np.bincount(doc, minlength=hi - lo)
        alone, after, size = _word_crcs(folded[at:end][inside], ends - starts)
        old = 0
        if at > offsets[lo] and carried is not None:  # the text began in an earlier slice
            old = len(carried[0])
            alone, after, size = (np.concatenate(x) for x in zip(carried, (alone, after, size)))
            doc = np.concatenate([np.zeros(old, doc.dtype), doc])
        keep = max(0, len(alone) - (most - 1))
        carried = [alone[keep:], after[keep:], size[keep:]] if end < offsets[hi] else None
        texts, buckets = [doc[old:]], [alone[old:] % np.uint32(BUCKETS)]
        run = alone
        for n in range(1, most):
            if len(run) < 2:
                break
            # the run that ends at word i: the run that ends at i - 1, a blank, word i
            run = _shift(run[:-1], size[n:]) ^ after[n:]
            whole = doc[n:] == doc[:-n]
            whole[:max(0, old - n)] = False
            texts.append(doc[n:][whole])
            buckets.append(run[whole] % np.uint32(BUCKETS))
        yield np.concatenate(texts), np.concatenate(buckets).astype(np.int64), lo, words


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, buckets, _, _ in features(batch["text"]):
            total += np.bincount(buckets, minlength=BUCKETS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Features in each bucket over all texts (an array of fixed size)."""
    rows = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed target share / smoothed raw share)) of all
    buckets, as longs."""
    total, wanted = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (total + BUCKETS)) / float((s + 1) * (wanted + BUCKETS))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def _weigh(gain: np.ndarray):
    gain = gain.astype(np.float64)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            features_of, weight, words = (np.zeros(n, np.int64) for _ in range(3))
            for doc, bucket, lo, found in features(batch["text"]):
                hi = lo + len(found)
                # sums of whole numbers below 2**53 are exact in doubles
                weight[lo:hi] += np.bincount(doc, weights=gain[bucket], minlength=hi - lo).astype(np.int64)
                features_of[lo:hi] += np.bincount(doc, minlength=hi - lo)
                words[lo:hi] += found
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "n_features": features_of, "weight": weight, "n_words": words})
    return run


def noise(id_col: Column, seed: int = 42) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of sha256 of
    ``<seed>:<id>``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def score(docs: DataFrame, gain: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, n_words, score) of every document."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    weighed = rows.mapInArrow(_weigh(gain), "id long, n_features long, weight long, n_words long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def bisect(rows: DataFrame, key: str, need: int, points: int = POINTS_A_JOB) -> int:
    """The smallest value v of the long column ``key`` with at least ``need``
    (1 or more) rows at or below it.  Every job counts at ``points`` values
    between the bounds."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0  # rows that are less than low
    while low < high:
        step = max(1, -(-(high - low) // (points + 1)))
        cuts = [c for c in range(low + step - 1, high, step)]
        # bounds that have met are filtered by the scan's statistics
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        counts = inside.agg(*[F.count(F.when(F.col(key) <= c, 1)) for c in cuts]).first()
        at = next((i for i, n in enumerate(counts) if below + n >= need), len(cuts))
        if at > 0:
            below, low = below + counts[at - 1], cuts[at - 1] + 1
        if at < len(cuts):
            high = cuts[at]
    return low


def draw(scores: DataFrame, take: int) -> tuple[Column, list[str]]:
    """Which rows are the first ``take`` of the written table ``scores`` by
    the long columns down, id, row (all ascending): a condition for each row,
    and the columns of the order."""
    order = ["down", "tie", "row"]
    drawn, same, rows = F.lit(False), F.lit(True), scores
    for key in order:
        if take < 1:
            break
        edge = bisect(rows, key, take)
        before, at = rows.agg(F.count(F.when(F.col(key) < edge, 1)), F.count(F.when(F.col(key) == edge, 1))).first()
        drawn = drawn | (same & (F.col(key) < edge))
        same, rows, take = same & (F.col(key) == edge), rows.where(F.col(key) == edge), take - before
        if take == at:  # the tied rows are all drawn
            return drawn | same, order
    return drawn, order


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every document.  Of the N
    documents with ``least_words`` words or more, floor(percent * N / 100) are
    drawn and have ranks from 1, best score first; the others' are null."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    scored = materialize(score(docs, gain, seed, id_col, text_col).select(
        "id", "n_features", "weight", "score", (-F.col("score")).alias("down"),
        F.coalesce("id", F.lit(LAST_ID)).alias("tie"), (F.col("n_words") >= least_words).alias("fit"),
        F.monotonically_increasing_id().alias("row")), "scores")
    fit = scored.where("fit")
    take = percent * fit.count() // 100
    shape = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    if take < 1:
        return scored.select(*shape, F.lit(None).cast("long").alias("rank"))
    drawn, order = draw(fit, take)
    drawn = F.col("fit") & drawn
    best = range_row_number(scored.where(drawn).select("id", "n_features", "weight", "score", *order), order, out="rank")
    rest = scored.where(~drawn).select(*shape, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(best.select(*shape, F.col("rank").cast("long").alias("rank")))
