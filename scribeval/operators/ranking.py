"""Exact row numbers without a single hot task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sorts each group in one
task; a group holding a third of all rows then holds a third of the job.
``range_row_number`` gives the same numbers with a range shuffle instead:

1. ``repartitionByRange`` on (g, k) spreads even one huge group over many
   partitions (boundaries come from a sample) and sorts inside each;
2. every row gets its position inside its partition
   (``monotonically_increasing_id`` is ``partition << 33 | position``);
3. a tiny table of (partition, g) -> row count gets running offsets per
   group (at most partitions + groups rows), joined back on (partition, g).

The ranked rows are written once as a table in the checkpoint folder so
both uses see the same positions; pass only the columns needed.

The order keys must make the order total (end them with a unique id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def range_row_number(df: DataFrame, order_cols: list[str], group_cols=None,
                     out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    if isinstance(group_cols, str):
        group_cols = [group_cols]
    group_cols = list(group_cols or [])
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df if group_cols else df.withColumn("_rank_all", F.lit(0))
    g = group_cols or ["_rank_all"]
    keys = g + list(order_cols)
    ranged = (
        base.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_rank_pid", F.spark_partition_id())
        .withColumn("_rank_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_rank_pid").cast("long"), 33))
    )
    # The positions are read twice (counts, numbering).  Two plans would run
    # two range shuffles whose sampled boundaries differ, so the positions
    # are written once as a table in the session's checkpoint folder (shared
    # storage on a cluster; also cuts the lineage, so a lost executor does
    # not re-run the range sampling).
    ranged = materialize(ranged, "ranks")
    counts = ranged.groupBy("_rank_pid", *g).agg(
        F.count("*").alias("_rank_cnt"), F.min("_rank_pos").alias("_rank_first"))
    w = Window.partitionBy(*g).orderBy("_rank_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_rank_pid").alias("_o_pid"),
        *[F.col(c).alias(f"_o_{i}") for i, c in enumerate(g)],
        F.col("_rank_first"),
        F.coalesce(F.sum("_rank_cnt").over(w), F.lit(0)).alias("_rank_off"),
    )
    # null group keys must meet their own offsets: null-safe join condition
    cond = [F.col("_rank_pid") == F.col("_o_pid")] + [F.col(c).eqNullSafe(F.col(f"_o_{i}")) for i, c in enumerate(g)]
    joined = ranged.join(offsets, on=cond, how="inner").drop("_o_pid", *[f"_o_{i}" for i in range(len(g))])
    res = joined.withColumn(out, F.col("_rank_off") + F.col("_rank_pos") - F.col("_rank_first") + 1).drop(
        "_rank_pid", "_rank_pos", "_rank_first", "_rank_off")
    return res if group_cols else res.drop("_rank_all")
