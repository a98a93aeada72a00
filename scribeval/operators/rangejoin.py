"""Range join: points in half-open ranges ``[start, end)`` of the same key.

Spark joins ranges by comparing all rows of a key.  Here places are cut into
buckets: a point lies in one, a range in those it touches, and the join is an
equi-join on key and bucket, so a key with a third of all rows is spread over
its buckets.  The bucket width is the mean length of the ranges (measured, one
aggregate): all ranges together then touch at most three buckets each on the
average, however different their lengths are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_width(ranges: DataFrame, start_col: str, end_col: str) -> int:
    mean = ranges.where(F.col(end_col) > F.col(start_col)).agg(F.avg(F.col(end_col) - F.col(start_col))).first()[0]
    return max(1, int(mean or 1))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point_col: str, start_col: str, end_col: str,
               width: int | None = None) -> DataFrame:
    """The columns of ``points`` and the other columns of ``ranges``, one row
    for each point and range that holds it; nulls meet nothing."""
    width = width or bucket_width(ranges, start_col, end_col)

    def bucket(c):
        return F.floor(c / F.lit(width)).cast("long")
    touched = ranges.where(F.col(end_col) > F.col(start_col)).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col(start_col)), bucket(F.col(end_col) - 1))))
    placed = points.where(F.col(point_col).isNotNull()).withColumn("_bucket", bucket(F.col(point_col)))
    met = placed.join(touched, [*keys, "_bucket"]).where((F.col(point_col) >= F.col(start_col)) & (F.col(point_col) < F.col(end_col)))
    return met.drop("_bucket")
