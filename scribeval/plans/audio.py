"""Audio preparation queries over ``clips`` (derived from ``embeddings``)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio as A
from ..operators.audiopieces import cut, normalize_pieces
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..streaming.chunk_windows import chunk_times, chunk_windows, stage_chunks

R = 9  # decimals kept in double arrays


def _round_arr(c):
    return F.transform(c, lambda x: F.round(x, R))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """clip_id, sampling_rate, mono, mono16k, pcm (int16 at 16 kHz)."""
    c = fx.recordings(spark, sf).withColumn("mono", A.downmix(F.col("left"), F.col("right")))
    c = c.withColumn("mono16k", A.resample(F.col("mono"), F.col("sampling_rate")))
    return c.withColumn("pcm", A.quantize(F.col("mono16k")))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The samples are cut first; only a chunk's own samples are encoded."""
    size = A.CHUNK_BYTES // 2
    p = prepared(spark, sf).select("clip_id", "pcm", A.chunk_count(F.size("pcm") * 2).alias("_nc"))
    cuts = F.when(F.col("_nc") > 0, F.sequence(F.lit(0), F.col("_nc") - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(cuts, lambda k: F.slice(F.col("pcm"), k * size + 1, F.lit(size)))
    ex = p.select("clip_id", F.posexplode(parts).alias("chunk_no", "part"))
    return ex.select("clip_id", "chunk_no", A.pcm_hex(F.col("part")).alias("payload_hex"),
                     (F.size("part") * 2).alias("n_bytes"), (F.col("chunk_no") * A.CHUNK_PAUSE_MS).alias("offset_ms"))


def aud_downmix(spark, sf):
    c = fx.clips(spark, sf)
    return c.select("clip_id", _round_arr(A.downmix(F.col("left"), F.col("right"))).alias("mono"))


def aud_resample(spark, sf):
    c = fx.clips(spark, sf)
    r = A.resample(F.col("left"), F.col("sampling_rate"))
    return c.select("clip_id", "sampling_rate", F.size(r).alias("n"), _round_arr(r).alias("resampled"))


def aud_quantize(spark, sf):
    c = fx.clips(spark, sf)
    return c.select("clip_id", A.quantize(F.col("left")).alias("pcm"))


def aud_normalize_job(spark, sf):
    p = prepared(spark, sf)
    return p.select("clip_id", F.size("pcm").alias("n_samples"), "pcm")


PIECE = 500  # samples; real pieces hold minutes


def aud_normalize_pieces(spark, sf):
    """The same job on clips that come as pieces (halo rows)."""
    return normalize_pieces(cut(fx.recordings(spark, sf), PIECE)).select("clip_id", "piece_no", F.size("pcm").alias("n_samples"), "pcm")


def aud_chunks(spark, sf):
    return chunks(spark, sf)


def snk_pcm_chunks(spark, sf):
    """Write the chunk table as Parquet (shared checkpoint folder) and read
    it back: the sink round trip."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/pcm_chunks/{uuid.uuid4().hex}"
    chunks(spark, sf).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def st_chunk_tumbling(spark, sf):
    """Streaming: chunks by send time in event-time windows of 100 ms."""
    feed = stage_chunks(chunk_times(chunks(spark, sf)), f"{checkpoint_dir(spark).rstrip('/')}/chunk_feed/{uuid.uuid4().hex}")
    return chunk_windows(spark, feed).windows.select(
        "clip_id", F.floor(F.unix_millis("start") / 100).alias("window_no"), "n_chunks", "n_bytes")


def q_audio_prepare(spark, sf):
    p = prepared(spark, sf).select("clip_id", "sampling_rate", "pcm")
    nb = F.size("pcm") * 2
    return p.select("clip_id", "sampling_rate", F.size("pcm").alias("n_samples"),
                    A.chunk_count(nb).alias("n_chunks"), nb.alias("n_bytes"),
                    F.aggregate("pcm", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("pcm_sum"))


# --- oracle ----------------------------------------------------------------------

CLIPS = """
clips AS (
  SELECT vec_id AS clip_id, label,
         CASE WHEN label % 3 = 0 THEN 8000 WHEN label % 3 = 1 THEN 16000 ELSE 22050 END AS sampling_rate,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l,
         list_reverse(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS r
  FROM embeddings
)"""


def _resample_sql(m: str, rate: str) -> str:
    ln = f"len({m})"
    n = f"CAST(floor(CAST({ln} AS DOUBLE) / CAST({rate} AS DOUBLE) * 16000.0::DOUBLE) AS INTEGER)"
    step = f"(CAST({ln} - 1 AS DOUBLE) / CAST({n} - 1 AS DOUBLE))"
    x = f"(CASE WHEN k = {n} - 1 THEN CAST({ln} - 1 AS DOUBLE) ELSE k * {step} END)"
    j = f"CAST(floor({x}) AS INTEGER)"
    y = f"CASE WHEN {j} >= {ln} - 1 THEN {m}[{ln}] ELSE ({m}[{j} + 2] - {m}[{j} + 1]) * ({x} - {j}) + {m}[{j} + 1] END"
    res = (f"CASE WHEN {n} <= 0 THEN []::DOUBLE[] WHEN {n} = 1 THEN [{m}[1]] "
           f"ELSE list_transform(range({n}), lambda k: {y}) END")
    return f"(CASE WHEN {rate} = 16000 THEN {m} ELSE {res} END)"


def _quant_sql(m: str) -> str:
    return f"list_transform({m}, lambda x: CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) * 32767) AS SMALLINT))"


def _hex_sql(pcm: str) -> str:
    u = "((CAST(v AS INTEGER) + 65536) % 65536)"
    return f"array_to_string(list_transform({pcm}, lambda v: lpad(hex({u} % 256), 2, '0') || lpad(hex({u} // 256), 2, '0')), '')"


PREP = f"""
recs AS (
  SELECT clip_id, sampling_rate, l, list_reverse(l) AS r FROM (
    SELECT min(clip_id) AS clip_id, sampling_rate, flatten(list(l ORDER BY clip_id)) AS l FROM clips
    GROUP BY label, sampling_rate, clip_id // 256)),
mono AS (SELECT clip_id, sampling_rate, list_transform(range(len(l)), lambda i: (l[i + 1] + r[i + 1]) / 2) AS m FROM recs),
res AS (SELECT clip_id, sampling_rate, {_resample_sql('m', 'sampling_rate')} AS m16 FROM mono),
prep AS (SELECT clip_id, sampling_rate, {_quant_sql('m16')} AS pcm FROM res),
prephex AS (SELECT clip_id, sampling_rate, pcm, {_hex_sql('pcm')} AS hx FROM prep),
chunks AS (
  SELECT clip_id, k AS chunk_no, substr(hx, k * 6400 + 1, 6400) AS payload_hex,
         CAST(length(substr(hx, k * 6400 + 1, 6400)) / 2 AS INTEGER) AS n_bytes, k * 20 AS offset_ms
  FROM (SELECT clip_id, hx, unnest(range(CAST(ceil(length(hx) / 2 / 3200.0) AS INTEGER))) AS k FROM prephex)
)"""


def _with(*tail):
    return "WITH " + ",".join([CLIPS, PREP, *tail])


def sql_aud_downmix():
    return _with() + """ SELECT clip_id, list_transform(range(len(l)), lambda i: round((l[i + 1] + r[i + 1]) / 2, 9)) AS mono FROM clips"""


def sql_aud_resample():
    r = _resample_sql("l", "sampling_rate")
    return _with() + f""" SELECT clip_id, sampling_rate, len({r}) AS n,
list_transform({r}, lambda x: round(x, 9)) AS resampled FROM clips"""


def sql_aud_quantize():
    return _with() + f" SELECT clip_id, {_quant_sql('l')} AS pcm FROM clips"


def sql_aud_normalize_job():
    return _with() + " SELECT clip_id, len(pcm) AS n_samples, pcm FROM prep"


def sql_aud_normalize_pieces():
    n = "CAST(floor(CAST(total AS DOUBLE) / CAST(sampling_rate AS DOUBLE) * 16000.0::DOUBLE) AS INTEGER)"
    step = f"(CAST(total - 1 AS DOUBLE) / CAST({n} - 1 AS DOUBLE))"
    at = f"CASE WHEN sampling_rate = 16000 OR {n} = 1 THEN k WHEN k = {n} - 1 THEN total - 1 ELSE least(CAST(floor(k * {step}) AS BIGINT), total - 1) END"
    return _with() + f""", samples AS (
  SELECT clip_id, sampling_rate, len(m) AS total, unnest(pcm) AS v, generate_subscripts(pcm, 1) - 1 AS k FROM prep JOIN mono USING (clip_id, sampling_rate)
)
SELECT clip_id, CAST(place // {PIECE} AS INTEGER) AS piece_no, len(list(v)) AS n_samples, list(v ORDER BY k) AS pcm
FROM (SELECT *, {at} AS place FROM samples) GROUP BY clip_id, place // {PIECE}"""


def sql_aud_chunks():
    return _with() + " SELECT clip_id, CAST(chunk_no AS INTEGER) AS chunk_no, payload_hex, n_bytes, CAST(offset_ms AS INTEGER) AS offset_ms FROM chunks"


def sql_snk_pcm_chunks():
    return sql_aud_chunks()


def sql_st_chunk_tumbling():
    return _with() + """ SELECT clip_id, CAST(floor(offset_ms / 100) AS BIGINT) AS window_no, count(*) AS n_chunks,
sum(n_bytes) AS n_bytes FROM chunks GROUP BY ALL"""


def sql_q_audio_prepare():
    return _with() + """ SELECT clip_id, sampling_rate, len(pcm) AS n_samples,
CAST(ceil(len(pcm) * 2 / 3200.0) AS INTEGER) AS n_chunks, len(pcm) * 2 AS n_bytes,
CAST(coalesce(list_sum(list_transform(pcm, lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS pcm_sum FROM prep"""


QUERIES = {k: globals()[k] for k in (
    "aud_downmix", "aud_resample", "aud_quantize", "aud_normalize_job", "aud_normalize_pieces", "aud_chunks",
    "snk_pcm_chunks", "st_chunk_tumbling", "q_audio_prepare")}
ORACLE = {k: globals()["sql_" + k] for k in QUERIES}
