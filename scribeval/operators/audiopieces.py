"""Audio longer than a row: clips as pieces, each with its neighbour's first
sample.

A clip is rows (clip_id, piece_no, left, right, sampling_rate) of any sizes,
in the order of piece_no.  Downmixing and quantising work on a piece alone.
Resampling interpolates between two samples that may stand in two pieces, so
every piece gets one sample of its successor (a halo) by an equi-join on the
clip and the piece's number; the clip's length and each piece's place come
from the pieces' sizes alone (one small row a piece).  An output sample belongs
to the piece that holds the sample at or before it, and is computed with its
number in the whole clip, so the pieces end to end are the whole clip's result
bit by bit.  No clip is ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import audio as A
from ..session import materialize


def cut(clips: DataFrame, size: int) -> DataFrame:
    """Rows with whole ``left`` and ``right`` arrays as pieces of ``size``."""
    pieces = F.sequence(F.lit(0), F.floor((F.size("left") - 1) / size).cast("int"))
    each = clips.where(F.size("left") > 0).select("*", F.explode(pieces).alias("piece_no"))
    part = [F.slice(c, F.col("piece_no") * size + 1, F.lit(size)).alias(c) for c in ("left", "right")]
    return each.select("clip_id", "sampling_rate", "piece_no", *part)


def with_halo(pieces: DataFrame) -> DataFrame:
    """Mono pieces (clip_id, sampling_rate, piece_no, mono) with ``start``,
    ``total`` and ``after``, the first sample of the next piece."""
    pieces = materialize(pieces.where(F.size("mono") > 0), "pieces")
    order = Window.partitionBy("clip_id").orderBy("piece_no")
    sizes = pieces.select("clip_id", "piece_no", F.size("mono").cast("long").alias("n"))
    places = sizes.select("clip_id", "piece_no", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
                          F.sum("n").over(Window.partitionBy("clip_id")).alias("total"), F.lead("piece_no").over(order).alias("_next"))
    heads = pieces.select(F.col("clip_id").alias("_clip"), F.col("piece_no").alias("_piece"), F.get("mono", F.lit(0)).alias("after"))
    placed = pieces.join(places, ["clip_id", "piece_no"])
    return placed.join(heads, (F.col("clip_id") == F.col("_clip")) & (F.col("_next") == F.col("_piece")), "left").drop("_clip", "_piece", "_next")


def _resampled(target: int) -> Column:
    """The piece's share of the clip's resampled samples, with the columns
    ``_n`` (samples of the whole result) and ``_step``."""
    start, end, total = F.col("start"), F.col("start") + F.size("mono"), F.col("total")

    def x(k):
        return F.when(k == F.col("_n") - 1, (total - 1).cast("double")).otherwise(k * F.col("_step"))

    def place(k):
        return F.least(F.floor(x(k)), total - 1)

    def sample(k):
        j = F.floor(x(k))
        a = F.get("mono", (j - start).cast("int"))
        b = F.when(j + 1 < end, F.get("mono", (j + 1 - start).cast("int"))).otherwise(F.col("after"))
        return F.when(j >= total - 1, F.get("mono", (total - 1 - start).cast("int"))).otherwise((b - a) * (x(k) - j) + a)
    # one more on either side, for rounding; then exactly those of the piece
    # (a step of 0, from a single sample, leaves the bounds of the whole)
    low = F.greatest(F.lit(0).cast("long"), F.floor(F.try_divide(start, "_step")) - 1)
    high = F.least(F.col("_n").cast("long") - 1, F.floor(F.try_divide(end, "_step")) + 1)
    none = F.array().cast("array<double>")
    own = F.filter(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")), lambda k: (place(k) >= start) & (place(k) < end))
    return (F.when(F.col("sampling_rate") == target, F.col("mono")).when(F.col("_n") <= 0, none)
            .when(F.col("_n") == 1, F.when(start == 0, F.array(F.get("mono", F.lit(0)))).otherwise(none)).otherwise(F.transform(own, sample)))


def normalize_pieces(pieces: DataFrame, target: int = A.TARGET_RATE) -> DataFrame:
    """(clip_id, piece_no, pcm): each piece's share of the clip as int16
    samples at the target rate; pieces without any are left out."""
    mono = pieces.select("clip_id", "sampling_rate", "piece_no", A.downmix(F.col("left"), F.col("right")).alias("mono"))
    p = with_halo(mono).withColumn("_n", A.resampled_length(F.col("total"), F.col("sampling_rate"), target))
    p = p.withColumn("_step", F.try_divide((F.col("total") - 1).cast("double"), (F.col("_n") - 1).cast("double")))
    out = p.select("clip_id", "piece_no", A.quantize(_resampled(target)).alias("pcm"))
    return out.where(F.size("pcm") > 0)
