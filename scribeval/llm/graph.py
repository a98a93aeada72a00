"""Connected components as Spark joins (alternating large-star / small-star).

``components(links)`` takes undirected links ``(u, v)`` and returns
``(node, component_id)`` with the smallest node reachable from each node.
Every round is two aggregations and two joins on the node; a hub with many
links is combined map-side (minimum) and its join partition may be split by
the adaptive skew join.  Each round is written as a table in the session's
checkpoint folder, so no lineage grows and nothing is collected but two
numbers that say whether the links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 64) -> DataFrame:
    """(node, component_id) of every node that occurs in a link to another
    node; null ends and self links are ignored."""
    now = materialize(
        links.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v"))
        .where("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)), "stars")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
