"""Selection and ranks by hash prefixes.

Rows in the order of a hash (hexadecimal text) need no range sampling: the
hash's first digits are a histogram key that spreads evenly by itself.

* ``kth_key`` finds the k-th row's key by counting rows for each prefix (one
  map-side combined aggregate with at most 65,536 groups) and looking deeper
  only inside the prefix that holds the place: what is first and what is last
  is then a comparison with two literals, without a shuffle or a table.
* ``hash_row_number`` numbers all rows: counts before a prefix plus the place
  inside it, one shuffle by prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits a level: 16 bits.
DIGITS = 4
#: Buckets of ``hash_row_number`` hold about so many rows, in powers of 16.
ROWS_A_BUCKET = 50_000
#: So many keys are fetched at most to settle the place.
FETCHED = 1000


@dataclass
class Place:
    """The key of the k-th row; ``n`` rows in all."""
    n: int
    k: int
    key: str | None
    id: int | None

    def reached_by(self, key_col: str, id_col: str) -> Column:
        """Whether a row stands at or before the place."""
        if self.key is None:
            return F.lit(False)
        key = F.col(key_col)
        return (key < self.key) | ((key == self.key) & (F.col(id_col) <= self.id))


def kth_key(rows: DataFrame, key_col: str, id_col: str, place) -> Place:
    """The k-th row by (hash, id), ``k = place(number of rows)``.  Rows that
    share both count as one place."""
    pair = F.struct(F.col(key_col).alias("key"), F.col(id_col).alias("id"))
    here, prefix, below, n, k = rows.where(F.col(id_col).isNotNull()), "", 0, None, None
    while True:
        digits = F.substring(key_col, len(prefix) + 1, DIGITS)
        bins = here.groupBy(digits.alias("digits")).agg(F.count("*").alias("count"), F.min(pair).alias("first"), F.max(pair).alias("last"))
        # a window over at most 65,536 bins
        order = Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("count").over(order))
        if n is None:
            total = bins.withColumn("n", F.sum("count").over(Window.partitionBy()))
            # k follows from n inside the same job
            row = total.where((place(F.col("n")) <= F.col("upto")) & (place(F.col("n")) > F.col("upto") - F.col("count"))).withColumn("k", place(F.col("n"))).first()
            if row is None:
                return Place(0, 0, None, None)
            n, k = row["n"], row["k"]
        else:
            row = bins.where((F.lit(k - below) <= F.col("upto")) & (F.lit(k - below) > F.col("upto") - F.col("count"))).first()
        start = below + row["upto"] - row["count"]
        if row["first"] == row["last"] or k == start + 1:
            return Place(n, k, *row["first"])
        if k == start + row["count"]:
            return Place(n, k, *row["last"])
        prefix, below = prefix + row["digits"], start
        here = here.where(F.col(key_col).startswith(prefix))
        if row["count"] <= FETCHED:
            keys = sorted(map(tuple, here.select(key_col, id_col).collect()))
            return Place(n, k, *keys[k - below - 1])


def hash_row_number(rows: DataFrame, key_col: str, id_col: str, n: int, out: str = "rn") -> DataFrame:
    """``rows`` with their places (from 1) by (hash, id); ``n`` is about the
    number of rows and only sets the size of the buckets."""
    digits = next((d for d in range(1, DIGITS) if n <= ROWS_A_BUCKET * 16 ** d), DIGITS)
    bucketed = rows.withColumn("_bucket", F.substring(key_col, 1, digits))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_count"))
    # at most 65,536 rows
    before = counts.select("_bucket", F.coalesce(F.sum("_count").over(
        Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(key_col, id_col)
    return bucketed.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(before), "_bucket").withColumn(
        out, F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in")
