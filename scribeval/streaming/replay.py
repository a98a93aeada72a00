"""Structured Streaming jobs over files that arrive in order.

``stage_slices`` writes a table as file slices by ranges of a column, in one
write; ``stage_feed`` also puts the files into the order of time, for streams
with a watermark.  The streaming jobs read them with ``maxFilesPerTrigger`` so
each micro-batch sees a few slices, and write to a sink in the shared checkpoint
folder.  The returned DataFrames read the sink back (batch), which is what a
downstream consumer would do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def stage_slices(df: DataFrame, path: str, order_col: str, n_slices: int = 6) -> str:
    """Write ``df`` once, as ``n_slices`` folders by ranges of ``order_col``."""
    b = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    lo, hi = (b.lo or 0), (b.hi or 0)
    width = max((hi - lo) / n_slices, 1e-9)
    part = F.least(F.floor((F.col(order_col) - F.lit(lo)) / F.lit(width)), F.lit(n_slices - 1))
    df.withColumn("_slice", part).write.partitionBy("_slice").mode("overwrite").parquet(path)
    return path


def stage_feed(events: DataFrame, path: str, ts_col: str, n_files: int, beat: dict, beat_after: str,
               slice_col: str | None = None) -> str:
    """Write ``events`` as ``n_files`` files in the order of ``ts_col``, or one
    file for each value of ``slice_col`` (0 to n_files - 1), and last a single
    row ``beat`` (other columns null) whose time is ``beat_after`` (an
    interval) behind the last event, to move the watermark past all of them.
    The input is read once and written as one partitioned table; as file
    sources take files by age, its slices are then copied one after the other,
    each read alone."""
    spark = events.sparkSession
    cols = [c for c in events.columns if c != slice_col]
    schema = events.select(*cols).schema
    if slice_col is None:
        # a range shuffle gives slices of like size, also where events are dense
        staged = events.repartitionByRange(n_files, ts_col, *[c for c in cols if c != ts_col]).withColumn("_slice", F.spark_partition_id())
    else:
        staged = events.select(*cols, F.col(slice_col).cast("int").alias("_slice")).repartition(n_files, "_slice")
    staged.write.partitionBy("_slice").parquet(f"{path}-table")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(f"{path}-table")
    for i in range(n_files):
        rows.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.parquet(f"{path}/part{i:06d}")
    last = rows.agg(F.max(ts_col).alias("_last")).where("_last IS NOT NULL")
    one = [(F.col("_last") + F.expr(beat_after) if f.name == ts_col else F.lit(beat.get(f.name))).cast(f.dataType).alias(f.name) for f in schema]
    last.select(*one).coalesce(1).write.parquet(f"{path}/part{n_files:06d}")
    return path


def _source(spark: SparkSession, path: str, schema, slices: int = 2) -> DataFrame:
    """A stream of the folders of ``stage_slices``, about ``slices`` of them in
    a micro-batch.  Every task of the write leaves a file in each folder, so a
    fixed number of files would make more batches of the same size the larger
    the table is."""
    found = spark.read.schema(schema).parquet(path).inputFiles()
    folders = len({f.rpartition("/")[0] for f in found})
    max_files = max(slices, -(-len(found) * slices // max(folders, 1)))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", "true").parquet(path))


def running_metrics(spark: SparkSession, src: str, schema) -> DataFrame:
    """Per dataset: results so far and their mean WER, updated per
    micro-batch (complete output, written as a snapshot each batch)."""
    out = scratch(spark, "running_metrics")
    agg = _source(spark, src, schema).where(F.col("error").isNull()).groupBy("dataset").agg(
        F.count("*").alias("samples"), F.avg("wer").alias("_avg"))

    def snapshot(batch: DataFrame, epoch: int) -> None:
        (batch.select("dataset", "samples", F.round(F.col("_avg") * 100, 9).alias("wer_pct"))
         .write.mode("overwrite").parquet(f"{out}/snapshot"))

    q = (agg.writeStream.outputMode("complete").foreachBatch(snapshot)
         .option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{out}/snapshot")


def prompt_dedup(spark: SparkSession, src: str, schema) -> DataFrame:
    """Each prompt announced once, however late it comes again: the state is
    one entry for each different prompt."""
    out = scratch(spark, "prompt_dedup")
    s = _source(spark, src, schema).dropDuplicates(["prompt"])
    q = (s.select("prompt", "candidate_id").writeStream.format("parquet").option("path", f"{out}/out")
         .option("checkpointLocation", f"{out}/ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema("prompt string, candidate_id int").parquet(f"{out}/out")
