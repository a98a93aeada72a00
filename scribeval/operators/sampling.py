"""Seeded train/validation split, dense audio ids and progress labels.

The split orders samples by ``md5(seed '#' sample_id)`` (identical in Spark
and SQL engines, unlike ``rand``) and keeps the first
``max(1, floor(n * train_share))`` as train.  ``train_split`` only tells the
two apart: the bound's hash is found by counting hash prefixes, and each row
is compared with it where it lies.  ``shuffle_split`` also numbers the rows,
by hash prefix, never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .radix import hash_row_number, kth_key
from .ranking import range_row_number

# --- fixed values -------------------------------------------------------------
SPLIT_SEED = 42
TRAIN_SHARE = 0.7
# ------------------------------------------------------------------------------


def seeded_key(id_col: str, seed: int = SPLIT_SEED):
    return F.md5(F.concat(F.lit(f"{seed}#"), F.col(id_col).cast("string")))


def one_row_join(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame to every row as scalar
    subqueries (computed once, no join)."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def _train_size(share: float):
    return lambda n: F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(share)).cast("long"))


def train_split(samples: DataFrame, id_col: str = "sample_id", seed: int = SPLIT_SEED,
                train_share: float = TRAIN_SHARE) -> DataFrame:
    """Adds ``split`` ('train'/'val'); the rows do not move."""
    keyed = samples.withColumn("_skey", seeded_key(id_col, seed))
    bound = kth_key(keyed.select("_skey", id_col), "_skey", id_col, _train_size(train_share))
    return keyed.withColumn("split", F.when(bound.reached_by("_skey", id_col), F.lit("train")).otherwise(F.lit("val"))).drop("_skey")


def shuffle_split(samples: DataFrame, id_col: str = "sample_id", seed: int = SPLIT_SEED,
                  train_share: float = TRAIN_SHARE) -> DataFrame:
    """Adds ``shuffle_rank`` (1-based), ``split`` ('train'/'val') and
    ``audio_id`` (0-based; train first, validation continues)."""
    keyed = samples.withColumn("_skey", seeded_key(id_col, seed))
    n = samples.select(id_col).count()
    ranked = hash_row_number(keyed, "_skey", id_col, n, out="shuffle_rank")
    return ranked.select(
        *samples.columns, "shuffle_rank",
        F.when(F.col("shuffle_rank") <= _train_size(train_share)(F.lit(n)), F.lit("train")).otherwise(F.lit("val")).alias("split"),
        (F.col("shuffle_rank") - 1).alias("audio_id"),
    )


def progress_labels(df: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """win_progress: ``i`` of ``total`` within each group, label 'i/total'."""
    ranked = range_row_number(df, [order_col], group_col, out="i")
    totals = df.groupBy(group_col).agg(F.count("*").alias("total")).withColumnRenamed(group_col, "_g")
    out = ranked.join(totals, ranked[group_col].eqNullSafe(totals["_g"])).drop("_g")
    return out.withColumn("label", F.concat(F.col("i").cast("string"), F.lit("/"), F.col("total").cast("string")))
