"""URL filters: a blocked Bloom filter before an exact hash join.

A rule names a host and a path prefix and fits that host and its subdomains.
The canonical form of a rule is host and path end to end (``example.org/en/``).
A URL has one key for each shape (number of host labels, length of path) that
occurs among the rules.  Keys that the Bloom filter of listed rules does not
pass are dropped where they stand; the rest meet the rules in an equi-join,
which removes false positives, and the longest rule wins.

The filter has a fixed largest size; with more rules it passes more keys, and
the join still decides.  One rule may fit a third of all URLs: the rules are
repeated over ``salts`` and every URL joins one copy.  URLs without a passing
key join on a key of their own, so they are spread too.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; a rule listed twice counts once, and blocks if any copy does;
of rules of equal length the one with the longer host wins; repeated pages
give repeated rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _passing(spark, words: np.ndarray):
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("array<boolean>")
    def passes(keys: pa.Array) -> pa.Array:
        flat = keys.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        stops = np.cumsum(keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()),
                                        pa.array(bloom.contains(shared.value, flat)))
    return passes


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
          salts: int = 16, max_filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """(id, host, path, rule, verdict); ``rules`` has host, path and verdict."""
    spark = pages.sparkSession
    listed = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL").select(
        F.concat("host", "path").alias("rule"), F.size(F.split("host", "[.]")).alias("labels"),
        F.length("path").alias("len"), F.length("host").alias("host_len"), "verdict").groupBy(
        "rule", "labels", "len", "host_len").agg(F.max("verdict").alias("verdict"))
    # one row for each shape of rule, bounded by the lengths of hosts and paths
    shapes = [(r["labels"], r["len"]) for r in listed.select("labels", "len").distinct().orderBy("labels", "len").collect()]
    most = max((labels for labels, _ in shapes), default=0)
    # path lengths by number of labels: one constant, however many rules there are
    lengths = F.from_json(F.lit(json.dumps([[n for k, n in shapes if k == labels] for labels in range(most + 1)])), "array<array<int>>")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host(F.col(f"`{url_col}`").cast("string")).alias("host"),
                        path(F.col(f"`{url_col}`").cast("string")).alias("path"))
    if not shapes:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    words = bloom.build(listed.select(F.xxhash64("rule").alias("key")), listed.count(), max_filter_bytes)
    own = F.sequence(F.lit(1), F.least(F.lit(most), F.size(F.split("host", "[.]"))))

    def of_labels(labels: Column) -> Column:
        tail = F.array_join(F.slice(F.split("host", "[.]"), -labels, labels), ".")
        fit = F.filter(F.get(lengths, labels), lambda n: n <= F.length("path"))
        return F.transform(fit, lambda n: F.concat(tail, F.substring(F.col("path"), F.lit(1), n)))
    keys = F.when(F.length("host") > 0, F.array_distinct(F.flatten(F.transform(own, of_labels)))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("keys", keys)
    hits = _passing(spark, words)(F.transform("keys", lambda k: F.xxhash64(k)))
    rows = rows.withColumn("keys", F.transform(F.filter(F.arrays_zip("keys", hits.alias("hits")), lambda z: z["hits"]),
                                               lambda z: z["keys"]))
    each = rows.select("id", "host", "path", F.posexplode_outer("keys").alias("pos", "key")).select(
        "id", "host", "path", F.coalesce("pos", F.lit(0)).alias("pos"),
        F.coalesce("key", F.concat(F.lit(" "), F.xxhash64("id", "path").cast("string"))).alias("key"),
        F.pmod(F.xxhash64("id", "path"), F.lit(salts)).alias("salt"))
    salted = listed.select(F.col("rule").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"),
                           F.struct(F.length("rule").alias("size"), "host_len", "rule", "verdict").alias("found"))
    judged = each.join(salted, ["key", "salt"], "left").groupBy("id", "host", "path").agg(
        F.max("found").alias("found"), F.sum((F.col("pos") == 0).cast("int")).alias("copies"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
