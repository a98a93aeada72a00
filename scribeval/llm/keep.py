"""Rows of a table without given ids, moving only the rows in doubt.

Ids may repeat.  Rows that share an id and a text are copies; rows that share
an id but not the text are documents of their own (``named`` gives them names
of their own), so that a group of copies of one does not take the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import bloom

#: Names made from id and text stand from here on, behind usual ids.
OWN_NAMES = 1 << 62


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A name (long) for each row: its id, or, where other rows have the id
    with another text, a hash of both.  A null id has no name."""
    name, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    of = docs.select(name.alias("id"), F.xxhash64(text).alias("h")).where("id IS NOT NULL")
    split = materialize(of.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("id"), "shared_ids")
    n = split.count()
    if not n:
        return name
    # what the filter passes by mistake gets a name of its own, too
    maybe = bloom.probe(docs.sparkSession, bloom.build(split, n))(name)
    own = F.xxhash64(name, text).bitwiseAND(F.lit(OWN_NAMES - 1)).bitwiseOR(F.lit(OWN_NAMES))
    return F.when(maybe, own).otherwise(name)


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", name: Column | None = None) -> DataFrame:
    """``docs`` with one row of each group: the row named (``name``, by default
    its id) like its group in ``groups (id, component_id)``.  A Bloom filter
    (fixed size) of the names that go, or that several rows share, lets all
    other rows pass where they lie; the rest is settled by an exact anti-join.
    Of rows that share a kept name the first by content stays; rows without a
    name stay."""
    judged = materialize(groups.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.min("component_id").alias("_group"), F.count("*").alias("_rows")), "groups")
    doubt = judged.where("_id <> _group OR _rows > 1").select("_id")
    words = bloom.build(doubt, doubt.count())
    # packed, so that no column of the documents clashes with ours
    name = F.col(f"`{id_col}`").cast("long") if name is None else name
    rows = docs.select(name.alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    maybe = bloom.probe(docs.sparkSession, words)(F.col("_id"))
    order = Window.partitionBy("_id").orderBy(F.xxhash64("_doc"))
    gone = judged.where("_id <> _group").select("_id")
    rest = rows.where(maybe).join(gone, "_id", "left_anti").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    kept = rows.where(~maybe).select("_doc").unionByName(rest.select("_doc"))
    return kept.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
