import random

import pytest
from pyspark.sql import functions as F

from scribeval.functions import audio as A
from scribeval.operators import audiopieces as P


def _clips(spark):
    r = random.Random(1)
    rows = [(i, rate, [r.uniform(-1.2, 1.2) for _ in range(n)]) for i, (rate, n) in enumerate(
        [(8000, 1), (8000, 2), (22050, 1), (22050, 2), (16000, 7), (8000, 100), (22050, 1000), (44100, 999), (11025, 640), (96000, 5), (192000, 3), (7999, 333)])]
    df = spark.createDataFrame(rows, "clip_id long, sampling_rate int, left array<double>")
    return df.withColumn("right", F.reverse("left"))


def _whole(clips):
    c = clips.withColumn("mono", A.downmix(F.col("left"), F.col("right"))).withColumn("m", A.resample(F.col("mono"), F.col("sampling_rate")))
    return {r.clip_id: r.pcm for r in c.select("clip_id", A.quantize(F.col("m")).alias("pcm")).collect() if r.pcm}


@pytest.mark.parametrize("size", [1, 2, 7, 64, 5000])
def test_pieces_are_the_whole_clip(spark, size):
    clips = _clips(spark)
    got = {}
    for r in P.normalize_pieces(P.cut(clips, size)).orderBy("clip_id", "piece_no").collect():
        got.setdefault(r.clip_id, []).extend(r.pcm)
    assert got == _whole(clips)


def test_pieces_of_any_size_and_number(spark):
    clips = _clips(spark).where("clip_id = 6")
    left = clips.first().left
    cuts = [0, 3, 3, 400, 401, 1000]
    rows = [(6, 22050, 10 * i - 5, left[a:b], left[::-1][a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    pieces = spark.createDataFrame(rows, "clip_id long, sampling_rate int, piece_no int, left array<double>, right array<double>").repartition(3)
    got = [x for r in P.normalize_pieces(pieces).orderBy("piece_no").collect() for x in r.pcm]
    assert got == _whole(clips)[6]
    assert P.normalize_pieces(pieces.limit(0)).count() == 0
