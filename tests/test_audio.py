import numpy as np
from pyspark.sql import functions as F

from scribeval.functions import audio as A


def _resample(spark, arr, orig, target):
    df = spark.createDataFrame([(arr, orig)], "a array<double>, r int")
    return df.select(A.resample(F.col("a"), F.col("r"), target).alias("x")).first().x


def test_resample_lengths_and_values(spark):
    ones = [1.0] * 16000
    assert len(_resample(spark, ones, 16000, 8000)) == 8000
    assert len(_resample(spark, [1.0] * 8000, 8000, 16000)) == 16000
    rnd = np.random.default_rng(5).random(101).tolist()
    got = np.array(_resample(spark, rnd, 22050, 16000))
    n = int(len(rnd) / 22050 * 16000)
    want = np.interp(np.linspace(0, len(rnd) - 1, n), np.arange(len(rnd)), rnd)
    assert np.allclose(got, want, atol=1e-12)
    assert _resample(spark, rnd, 16000, 16000) == rnd


def test_chunks_are_cut(spark):
    from scribeval.plans import audio
    rows = audio.aud_chunks(spark, "/root/testdata/sf0.01").collect()
    last = {}
    for r in rows:
        last[r.clip_id] = max(last.get(r.clip_id, 0), r.chunk_no)
    assert max(last.values()) > 1
    for r in rows:
        assert r.n_bytes == len(r.payload_hex) // 2
        assert r.n_bytes == 3200 if r.chunk_no < last[r.clip_id] else 0 < r.n_bytes <= 3200
    assert any(r.n_bytes < 3200 for r in rows)


def test_quantize_and_chunks(spark):
    sig = [0.5, -0.5, 1.2, -1.0, 0.99999]
    df = spark.createDataFrame([(sig,)], "a array<double>")
    pcm = df.select(A.quantize(F.col("a")).alias("p")).first().p
    assert pcm == [16383, -16383, 32767, -32767, 32766]
    hexed = df.select(A.pcm_hex(A.quantize(F.col("a"))).alias("h")).first().h
    assert bytes.fromhex(hexed) == np.array(pcm, dtype="<i2").tobytes()
    n = spark.createDataFrame([(6401,), (3200,), (0,)], "b int").select(A.chunk_count(F.col("b")).alias("c"))
    assert [r.c for r in n.collect()] == [3, 1, 0]
