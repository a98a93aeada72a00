"""Audio chunks under event-time tumbling windows.

A chunk's event time is its send time.  The stream counts chunks and bytes of
each clip in windows of 100 ms; a window is emitted once, when the watermark
has passed its end, and its state goes with it.  Chunks behind the watermark
are dropped and counted from the query's progress.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .replay import scratch, stage_feed

CHUNK_SCHEMA = "clip_id long, chunk_no int, n_bytes int, sent_at timestamp"
OUT_SCHEMA = "clip_id long, start timestamp, end timestamp, n_chunks long, n_bytes long"
WINDOW = "100 milliseconds"
DELAY = "100 milliseconds"


@dataclass
class WindowRun:
    """Windows emitted by a stream, chunks it dropped as late, and rows of
    state it held at its end."""
    windows: DataFrame
    dropped: int
    state_rows: int


def chunk_times(chunks: DataFrame) -> DataFrame:
    """Chunks (clip_id, chunk_no, n_bytes, offset_ms) with their send times;
    every clip's stream starts at time 0."""
    return chunks.select(F.col("clip_id").cast("long").alias("clip_id"), F.col("chunk_no").cast("int").alias("chunk_no"),
                         F.col("n_bytes").cast("int").alias("n_bytes"), F.timestamp_millis(F.col("offset_ms").cast("long")).alias("sent_at"))


def stage_chunks(chunks: DataFrame, path: str, n_files: int = 6, slice_col: str | None = None) -> str:
    """Files of chunks in the order of their send times, and a heartbeat (a
    chunk of no clip) a second later."""
    return stage_feed(chunks, path, "sent_at", n_files, {}, "INTERVAL 1 SECOND", slice_col)


def tumbling(chunks: DataFrame, window: str = WINDOW, delay: str = DELAY) -> DataFrame:
    """Chunks and bytes of each clip in each window of send time; works on
    streams and tables."""
    return chunks.withWatermark("sent_at", delay).groupBy(F.window("sent_at", window).alias("w"), "clip_id").agg(
        F.count("*").alias("n_chunks"), F.sum("n_bytes").alias("n_bytes")).select(
        "clip_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_chunks", "n_bytes")


def chunk_windows(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 1) -> WindowRun:
    """Run the windows over all chunk files in ``source_dir``."""
    out = scratch(spark, "chunk_windows")
    stream = (spark.readStream.schema(CHUNK_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .option("recursiveFileLookup", "true").parquet(source_dir))
    q = (tumbling(stream).writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    state = [op for p in q.recentProgress for op in p["stateOperators"]]
    windows = spark.read.schema(OUT_SCHEMA).parquet(f"{out}/out").where("clip_id IS NOT NULL")
    return WindowRun(windows, sum(op["numRowsDroppedByWatermark"] for op in state), state[-1]["numRowsTotal"] if state else 0)
