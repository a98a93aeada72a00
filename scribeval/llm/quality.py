"""Text quality by compression: which of two dictionaries fits a text better.

Two zstandard dictionaries are built from pieces of labelled texts, one from
good and one from bad texts.  A text is compressed with each, piece by piece
(so that the dictionary, not the text's own past, is what helps), and the
difference of the two sizes over the text's length is its raw figure.  Held
texts that built no dictionary calibrate the figure: isotonic regression
(pool adjacent violators) gives the share of good texts at each figure, and
between the pools the score is interpolated, so a score is a probability.

Fitting reads a bounded sample (``max_rows`` labelled texts, ``max_pieces``
pieces of ``PIECE`` bytes for each dictionary, taken by hash from all over the
whole texts); one half of the texts builds the dictionaries, the other one
calibrates.  The model has a fixed size and is broadcast.  Scoring is one
Arrow function over all whole texts; nothing is shuffled.

Edge cases: labels other than 0 and 1, null ids and labels without a document
are ignored; a document with both labels counts once as each; repeated rows
(same id and text) count once in fitting and are scored alike.  Without
labelled texts of both classes in both halves every score is the share of
good labels (0.5 without any).  A null or empty text has the figure 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .memory import release
from .words import text_buffer

LEVEL = 3
DICTIONARY_BYTES = 1 << 16
#: A text is compressed in parts of so many bytes.
PART = 2048
#: Dictionaries are built from pieces of so many bytes.
PIECE = 500
#: Added to the length, so that very short texts stay near 0.
SHORT = 50
#: The rows that calibrate count beside this many of the average.
PRIOR = 0.5
SPACE = 1 << 62


@dataclass
class Model:
    """Dictionaries of bad and good texts; the score at each of ``figures``."""
    bad: bytes
    good: bytes
    figures: np.ndarray
    scores: np.ndarray

    def calibrated(self, figure: np.ndarray) -> np.ndarray:
        return np.interp(figure, self.figures, self.scores)


@lru_cache(maxsize=2)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False)


def figures(column, bad: bytes, good: bytes) -> np.ndarray:
    """(size with the bad - size with the good dictionary) / length of every text."""
    out = np.zeros(len(column))
    if not bad or not good:
        return out
    sides = [_compressor(bad).compress, _compressor(good).compress]
    buf, offsets = text_buffer(column)
    view = memoryview(np.ascontiguousarray(buf))
    for i, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        more = 0
        for lo in range(at, end, PART):
            part = view[lo:min(end, lo + PART)]
            more += len(sides[0](part)) - len(sides[1](part))
        out[i] = more / (end - at + SHORT)
    release()
    return out


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Ids whose labels may not be learnt."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _pieces(batches):
    """The pieces of every text, each with a hash of its text and place."""
    for batch in batches:
        buf, offsets = text_buffer(batch["text"])
        keys, goods = batch["key"].to_pylist(), batch["good"].to_pylist()
        for at, end, key, good in zip(offsets[:-1].tolist(), offsets[1:].tolist(), keys, goods):
            starts = np.arange(at, end, PIECE)
            for lo in range(0, len(starts), 4096):  # a long text in several batches
                some = starts[lo:lo + 4096]
                yield pa.RecordBatch.from_pydict({
                    "good": pa.array([good] * len(some), pa.int32()), "key": pa.array([key] * len(some), pa.int64()),
                    "place": pa.array(some - at, pa.int64()),
                    "piece": pa.array([buf[s:min(end, s + PIECE)].tobytes() for s in some.tolist()], pa.binary())})


def _build(table: pa.Table) -> pa.Table:
    """The dictionary of one class."""
    table = table.sort_by([("order", "ascending"), ("key", "ascending"), ("place", "ascending")])
    pieces = table["piece"].to_pylist()
    try:
        content = zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few pieces to choose from: take them as they are
        content = b"".join(pieces)[-DICTIONARY_BYTES:]
    return pa.table({"good": pa.array([table["good"][0].as_py()], pa.int32()), "content": pa.array([content], pa.binary())})


def calibrate(figure: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: (mean figure, share of good, drawn a little to
    the average) of the pools, both ascending."""
    order = np.argsort(figure, kind="stable")
    pools: list[list[float]] = []  # rows, sum of figures, good ones
    for x, y in zip(figure[order].tolist(), good[order].tolist()):
        pools.append([1.0, x, float(y)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    n, x, y = np.array(pools).T
    share = (y + PRIOR * good.mean()) / (n + PRIOR)
    return x / n, np.maximum.accumulate(share)


def _share(order: Column, keep: int, n: int) -> Column:
    """About ``keep`` of ``n`` rows: those with the smallest hashes."""
    return F.pmod(order, F.lit(SPACE)) < F.lit(SPACE if n <= keep else int(SPACE * (keep / n)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = 8000, max_pieces: int = 16_000) -> Model:
    """Fit on about ``max_rows`` of the labels for which ``learn`` holds (a
    condition on the columns of ``labels``)."""
    known = (labels.where(learn).select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("good"))
             .where("good IN (0, 1) AND _id IS NOT NULL").distinct())
    n, share = known.agg(F.count("*"), F.avg("good")).first()
    average = float(share) if n else 0.5
    empty = Model(b"", b"", np.zeros(1), np.full(1, average))
    # bounded by max_rows: 12 bytes a row
    sample = F.broadcast(known.where(_share(F.xxhash64("_id"), max_rows, n)))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.join(sample, "_id").select(F.xxhash64("_id", "text").alias("key"), "good", "text")
    # an id may have many rows: repeated ones count once, and the bound holds for rows
    distinct = rows.select("key", "good").distinct().count()
    rows = materialize(
        rows.where(_share(F.xxhash64("key", F.lit(1)), max_rows, distinct)).groupBy("key", "good").agg(F.first("text").alias("text"))
        .withColumn("half", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(2))), "labelled")

    pieces = rows.where("half = 0").select("key", "good", "text").mapInArrow(
        _pieces, "good int, key long, place long, piece binary").withColumn("order", F.xxhash64("key", "place"))
    counts = dict(pieces.groupBy("good").count().collect())
    if len(counts) < 2:
        return empty
    kept = pieces.where(F.when(F.col("good") == 0, _share(F.col("order"), max_pieces, counts[0]))
                        .otherwise(_share(F.col("order"), max_pieces, counts[1])))
    # two tasks of at most about max_pieces * PIECE bytes
    content = dict(kept.groupBy("good").applyInArrow(_build, "good int, content binary").collect())
    if len(content) < 2:
        return empty
    bad, good = bytes(content[0]), bytes(content[1])

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": batch["key"], "good": batch["good"], "figure": figures(batch["text"], bad, good)})
    # bounded by max_rows: 20 bytes a row
    measured = sorted(rows.where("half = 1").select("key", "good", "text").mapInArrow(measure, "key long, good int, figure double").collect())
    y = np.array([r["good"] for r in measured])
    if not len(y) or y.min() == y.max():
        return empty
    return Model(bad, good, *calibrate(np.array([r["figure"] for r in measured]), y))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score, 0 to 1; a column of its name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(text: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array(m.calibrated(figures(text, m.bad, m.good)))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != out]
    return docs.select(*keep, judge(F.col(f"`{text_col}`").cast("string")).alias(out))
