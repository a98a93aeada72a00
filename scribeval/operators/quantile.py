"""Exact and approximate quantiles of many groups without sorting values.

``exact_percentile`` selects by histogram refinement.  Every round is one
map-side counted histogram: the values still in question of each group fall
into bins, each bin brings its count and its smallest and largest value, and
a running count over the group's bins (thousands at most) tells which bin
holds the wanted place.  The next round looks only at the values between that
bin's smallest and largest one.  Bins of the first round are even on a log
scale on both sides of zero, so values of very different sizes part at once
and a bin's values are of like size; later rounds cut the bracket evenly.  As
the smallest and the largest value of a bracket never share a bin, every round
makes progress; about six find the value among any number of rows.  What is
shuffled in a round is bounded by groups times bins.

``quantile_sketches`` is the choice for running totals: mergeable KLL sketches
of fixed size, one for each group, that can be stored and added up later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BINS = 2048
#: Bins a unit of the logarithm in the first round.
FIRST_BINS_A_UNIT = 64
#: Above the logarithm's size for all doubles, so that both sides of zero part.
LOG_RANGE = 746
#: Values that no width cuts (infinite, not a number) have bins of their own.
LOWEST, HIGHEST, NOT_A_NUMBER = -(1 << 61), 1 << 61, 1 << 62


def _first_bin(v: Column) -> Column:
    size = F.floor((F.log(F.abs(v)) + LOG_RANGE) * FIRST_BINS_A_UNIT) + 1
    return (F.when(F.isnan(v), F.lit(NOT_A_NUMBER)).when(v == F.lit(float("inf")), F.lit(HIGHEST))
            .when(v == F.lit(float("-inf")), F.lit(LOWEST)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))).cast("long")


def _next_bin(v: Column, low: Column, high: Column) -> Column:
    """Bin of v in [low, high], low < high, both finite and of like size."""
    at = F.floor((v - low) / (high - low) * BINS)
    # rounding may not carry the bracket's ends into each other's bins
    return F.when(v == high, F.lit(BINS)).otherwise(F.least(at, F.lit(BINS - 1))).cast("long")


def _chosen(binned: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The bin that holds the 0-based place ``at`` (a column of ``binned``, as
    are ``below``, the values before the bracket, and ``above``, the smallest
    value behind it)."""
    bins = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
                                            F.first("at").alias("at"), F.first("below").alias("below"), F.first("above").alias("above"))
    order = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(order) + F.col("below")).withColumn("above", F.coalesce(F.lead("low").over(order), "above"))
    return bins.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))).select(
        *keys, "at", (F.col("upto") - F.col("n")).alias("below"), "upto", "low", "high", "above")


def exact_percentile(df: DataFrame, value_col: str, key_cols: list[str], p: float, out: str) -> DataFrame:
    """Per key: the p-quantile of ``value_col`` with linear interpolation
    (numpy ``percentile`` / SQL ``quantile_cont``); nulls ignored, NaN counts
    as the largest value."""
    vals = df.select(*key_cols, F.col(value_col).cast("double").alias("v")).where("v IS NOT NULL")
    order = Window.partitionBy(*key_cols).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*key_cols)
    first = (vals.groupBy(*key_cols, _first_bin(F.col("v")).alias("bin")).agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(every))
        .withColumn("above", F.lead("low").over(Window.partitionBy(*key_cols).orderBy("bin")))
        .withColumn("at", F.floor((F.col("all") - 1) * F.lit(p))))
    part = ((F.col("all") - 1) * F.lit(p) - F.col("at")).alias("part")
    now = materialize(first.where("at < upto AND at >= upto - n").select(
        *key_cols, "at", (F.col("upto") - F.col("n")).alias("below"), "upto", "low", "high", "above", part), "quantile")
    done = None
    while True:
        found = now.where(F.col("low").eqNullSafe(F.col("high"))).select(
            *key_cols, "at", "upto", F.col("low").alias("lower"), "above", "part")
        done = found if done is None else done.unionByName(found)
        now = now.where(~F.col("low").eqNullSafe(F.col("high")))
        if now.isEmpty():
            break
        # one bracket for each group; null keys meet their own
        bracket = now.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)], "at", "below", "low", "high", "above")
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key_cols)]
        inside = vals.join(bracket, on=[*same, F.col("v").between(F.col("low"), F.col("high"))]).select(
            *key_cols, "v", "at", "below", "above", _next_bin(F.col("v"), F.col("low"), F.col("high")).alias("bin"))
        parts = now.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)], "part")
        now = materialize(_chosen(inside, key_cols, F.col("at")).join(parts, on=same).drop(*[f"_k{i}" for i in range(len(key_cols))]), "quantile")
    # the next value is the same one unless the place is the value's last
    upper = F.when(F.col("at") + 1 < F.col("upto"), F.col("lower")).otherwise(F.coalesce("above", "lower"))
    value = F.when(F.col("part") == 0, F.col("lower")).otherwise(F.col("lower") + F.col("part") * (upper - F.col("lower")))
    return done.select(*key_cols, value.alias(out))


def quantile_sketches(df: DataFrame, value_col: str, key_cols: list[str], out: str = "sketch", k: int = 200) -> DataFrame:
    """Per key a KLL sketch (a few KB whatever the rows); sketches of several
    tables or keys add up with ``merged_sketches``."""
    return df.where(F.col(value_col).isNotNull()).groupBy(*key_cols).agg(
        F.kll_sketch_agg_double(F.col(value_col).cast("double"), k).alias(out))


def merged_sketches(sketches: DataFrame, key_cols: list[str], sketch_col: str = "sketch") -> DataFrame:
    """The sketches of each of the (coarser) keys added up."""
    return sketches.groupBy(*key_cols).agg(F.kll_merge_agg_double(sketch_col).alias(sketch_col))


def sketched_quantile(sketch_col: str, p: float) -> Column:
    """The p-quantile that a sketch knows (rank error about 1.3 % at k = 200)."""
    return F.kll_sketch_get_quantile_double(F.col(sketch_col), F.lit(p))
