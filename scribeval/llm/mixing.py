"""Mixing sources to target weights along a time-varying curriculum.

**Amounts.** The mix holds ``share`` times all words.  Sources, by code point
with null last, weigh ``weights`` in turn; a source's target is its weighted
part, at most ``cap`` times its own words, and what is cut off is shared
again by weight until no source is above its cap.

**Curriculum.** A source's weight moves during training: its schedule is
piecewise linear over time 0..1 with a mean of one, so the weights above are
what it holds over the whole run.  The integral of the schedule is the
source's cumulative demand.  Its documents stand in a fixed pseudo-random
order, repeated from the start when the target exceeds its words; the copy
whose words lie in the middle of the demand ``y`` gets the training position
``t`` with ``demand(t) = y`` (a quadratic on each piece of the schedule).
``curriculum`` writes the copies range-sorted by position, with the words taken of
each; ``training_order`` range-sorts their texts.

The plan takes the last document of a source's last pass in part, so its words
meet the target to a word.  ``training_order`` cuts no text: it takes that
document whole if at least half of it is wanted, else not at all.

How Spark does it: word counts are written once, without the texts; a
source's order is cut into 4096 hash buckets, whose sums are aggregated
(map-side first) and accumulated per source; inside a bucket a window gives
the rest.  So a source with a third of all rows is spread over thousands of
windows, and no join has the source alone as its key.  The level of the
targets comes from a few aggregations over the source table.

Edge cases: null or wordless texts have size 0 and are not taken; documents
with equal hash are ordered by id and then content; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import range_row_number
from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Multipliers of a source's weight at given times, one schedule per weight
#: in turn: falling, level and rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def inverse_demand(y: Column, schedule) -> Column:
    """The time at which the integral of the schedule reaches ``y`` (0..1)."""
    total = sum((b - a) * (p + q) / 2 for (a, p), (b, q) in zip(schedule[:-1], schedule[1:]))
    out, before = None, 0.0
    pieces = []
    for (a, p), (b, q) in zip(schedule[:-1], schedule[1:]):
        area = (b - a) * (p + q) / 2 / total
        pieces.append((before, a, p / total, (q - p) / (b - a) / total))
        before += area
    for begin, a, p, slope in reversed(pieces):
        over = y - F.lit(begin)
        t = F.lit(a) + F.lit(2.0) * over / (F.lit(p) + F.sqrt(F.lit(p * p) + F.lit(2.0 * slope) * over))
        t = F.when(over <= 0, F.lit(a)).otherwise(t)
        out = t if out is None else F.when(y < F.lit(nxt), t).otherwise(out)
        nxt = begin
    return out


def _level(sources: DataFrame, wanted: float, cap: float) -> float:
    """The level L with sum(min(weight * L, cap * size)) = wanted: capped
    sources are set aside until none is added (scalars only)."""
    level = 0.0
    while True:  # every turn sets at least one more source aside
        r = sources.agg(
            F.sum(F.when(F.col("weight") * F.lit(level) >= F.col("source_size") * cap, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(F.col("weight") * F.lit(level) >= F.col("source_size") * cap, 0).otherwise(F.col("weight"))).alias("free")).first()
        if not r["free"]:
            return float("inf") if r["held"] else 0.0
        new = (wanted - cap * r["held"]) / r["free"]
        if new <= level:
            return level
        level = new


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0, schedules: tuple = SCHEDULES) -> DataFrame:
    """One row per document: _id, _row (hash of all its columns), source, size,
    source_size, target, taken (words), passes (whole copies), last (words of
    a further copy), positions (training position of each copy), and _bucket and
    _no, which name the document within its source."""
    name = F.col(f"`{source_col}`").cast("string")
    sized = materialize(docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        name.alias("source"), F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name)).alias("_source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).alias("_order")), "sizes")
    bucket = F.substring("_order", 1, 3)
    parts = materialize(sized.groupBy("_source", F.isnull("source").alias("_last"), "source", bucket.alias("_bucket")).agg(
        F.sum("size").alias("words")), "buckets")
    sources = parts.groupBy("_source", "_last", "source").agg(F.sum("words").alias("source_size"))
    turn = (F.col("rn") - 1) % len(weights)
    sources = range_row_number(sources, ["_last", "source"]).withColumn("turn", turn.cast("int")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = _level(sources, share * total, cap)
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(level))
    sources = sources.select("_source", "source_size", "turn", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = parts.join(sources, "_source").select(
        "_source", "_bucket", "source_size", "target", "turn", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "_row")
    placed = sized.withColumn("_bucket", bucket).join(buckets, ["_source", "_bucket"]).withColumn(
        "_at", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("_no", F.row_number().over(numbered))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("passes", passes).withColumn(
        "_rest", F.floor(F.col("target") - F.col("passes") * F.col("source_size") + 0.5).cast("long")).withColumn(
        "last", F.least(F.greatest(F.col("_rest") - F.col("_at"), F.lit(0).cast("long")), F.col("size"))).withColumn(
        "taken", F.col("passes") * F.col("size") + F.col("last"))

    def position(copy: Column, words: Column) -> Column:
        y = (copy * F.col("source_size") + F.col("_at") + words / 2) / F.col("target")
        y = F.least(y, F.lit(1.0))
        out = inverse_demand(y, schedules[0])
        for i, s in enumerate(schedules[1:], 1):
            out = F.when(F.col("turn") % len(schedules) == i, inverse_demand(y, s)).otherwise(out)
        return out

    copies = F.col("passes") + (F.col("last") > 0).cast("long")
    numbers = F.when((F.col("size") > 0) & (copies > 0), F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(
        F.array().cast("array<long>"))
    return placed.withColumn("positions", F.transform(numbers, lambda c: position(
        c, F.when(c < F.col("passes"), F.col("size")).otherwise(F.col("last"))))).select(
        "_id", "_row", "source", "size", "source_size", "target", "taken", "passes", "last", "positions", "_bucket", "_no")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The mix as copies without their texts, written range-sorted by training
    position: the plan's columns of the document, words (taken of this copy; the
    last one may be taken in part) and position.  A document that the mix leaves
    out has one row without a position, before all others."""
    plans = plan(docs, id_col, text_col, **settings)
    copies = F.transform("positions", lambda p, c: F.struct(
        p.alias("position"), F.when(c < F.col("passes"), F.col("size")).otherwise(F.col("last")).alias("words")))
    each = plans.withColumn("_copy", F.explode_outer(copies)).select(
        "_id", "_row", "source", "_bucket", "_no", "size", "source_size", "target",
        F.coalesce("_copy.words", F.lit(0).cast("long")).alias("words"), F.col("_copy.position").alias("position"))
    place = ["position", "_bucket", "_no"]  # rows without a position are many: they are dealt by document
    return materialize(each.repartitionByRange(*place).sortWithinPartitions(*place), "curriculum")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row per copy, range-sorted
    by training position.  All copies are whole."""
    columns = list(docs.columns)
    same = Window.partitionBy("_id", "_row").orderBy("_row")
    # the copy taken in part is the last one
    fits = F.col("passes") + (2 * F.col("last") >= F.col("size")).cast("int")
    plans = plan(docs, id_col, text_col, **settings).where("taken > 0").select(
        "_id", "_row", F.slice("positions", F.lit(1), fits.cast("int")).alias("positions"),
        F.row_number().over(same).alias("_copy")).toDF("_pid", "_prow", "positions", "_pcopy")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), F.col(f"`{id_col}`").alias("_id"),
                       F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    rows = rows.withColumn("_copy", F.row_number().over(same))
    met = rows.join(plans, F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("_row") == F.col("_prow")) & (F.col("_copy") == F.col("_pcopy")))
    each = met.select("_doc", F.explode("positions").alias("_position"))
    ordered = each.repartitionByRange("_position").sortWithinPartitions("_position", F.col("_doc")[id_col])
    return ordered.select(*[F.col("_doc")[c].alias(c) for c in columns])
