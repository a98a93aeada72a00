"""Hard negatives for contrastive training, by coordinate pruning.

Vectors become integers by ``floor(scale * x)`` and are compared by integer
inner product.  For each anchor the nearest rows of its own label are its
positives; for each positive the nearest rows of other labels whose score
lies within given shares of the positive's score are its hard negatives.
Both searches are exact.

Rows are dealt into groups of bounded size, the positives' search within a
label, the negatives' search by length, so that an anchor is sent only to
groups whose longest vector can still reach its least wanted score.  Each
(group, block of anchors) is worked on by one task call:

1. the group's rows, longest first, are cut into length buckets; a bucket
   holds its rows' directions (vectors over their lengths) as one sorted list
   of values for each coordinate;
2. for an anchor, a wanted score and a bucket the direction must have at
   least the cosine ``wanted / (anchor's length * longest length)``; a bucket
   where this is above 1 ends the search, as later ones are shorter;
3. on the anchor's focus coordinates (those with its largest values) this
   leaves a feasible range of values: with ``a`` the angle between anchor and
   axis and ``t`` the arc cosine of the bound, ``[cos(a + t), cos(a - t)]``.
   Binary search finds each range in its list, and the rows that lie in all
   ranges are the candidates;
4. candidates are verified by their exact scores.  The k-th best score found
   so far raises the wanted score for the next bucket.

The best of all groups are merged by a window that keeps k rows per anchor
and task before the shuffle.

Edge cases: rows with a null id or label, null or empty vectors and vectors
with null or non-finite components take no part; vectors meet only vectors of
their own length in components; rows that share the anchor's id are neither
positives nor negatives of it; repeated candidate rows count each, a repeated
anchor (same id, label and vector) once; ties go to the smaller id; an anchor
without positives has no rows, and so has a positive with a negative score
(no score lies in its band).  Components beyond 2**20 are multiplied as
Python integers without pruning, and scores beyond 64 bits are held at the
ends of that range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .topk_search import finite

#: Components that a group of rows, or a block of anchors, holds.
CELLS = 1 << 20
ROWS_A_BUCKET = 1024
FOCUS = 4
LENGTH_CLASSES = 16
#: Group tables of up to so many rows (40 bytes each) are broadcast.
SMALL_TABLE = 100_000
#: Integers up to here are multiplied as doubles (exact below 2**53).
SMALL = 1 << 20
#: Covers the rounding of lengths, arc cosines and directions.
SLACK = 1e-7


def _integers(column, dim: int, scale: float):
    """(rows as whole doubles, or None, and the rows as Python integers)."""
    flat = column.combine_chunks().flatten().to_numpy().astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(flat * scale)
    if np.abs(x).max(initial=0.0) <= SMALL and dim < 1 << 12:
        return x.reshape(-1, dim), None
    # doubles of 2**53 and more are whole, so the product is exact as well
    exact = [math.floor(v * scale) if abs(v) < 1 << 53 else int(v) * int(scale) for v in flat.tolist()]
    return None, [exact[i:i + dim] for i in range(0, len(exact), dim)]


class Bucket:
    """Rows of similar length with sorted values of every coordinate."""

    def __init__(self, rows: np.ndarray, places: np.ndarray, lengths: np.ndarray):
        self.rows, self.places, self.longest = rows, places, float(lengths[0])
        unit = rows / np.maximum(lengths, 1.0)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.values = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, direction: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that lie in the feasible range of every focus coordinate."""
        turn = math.acos(min(1.0, cosine))
        ranges = []
        for f in focus.tolist():
            angle = math.acos(max(-1.0, min(1.0, direction[f])))
            low, high = math.cos(min(math.pi, angle + turn)) - SLACK, math.cos(max(0.0, angle - turn)) + SLACK
            values = self.values[:, f]
            lo, hi = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            if hi - lo < len(values):
                ranges.append((hi - lo, f, lo, hi))
        if not ranges:
            return np.arange(len(self.rows))
        ranges.sort()
        _, f, lo, hi = ranges[0]
        found = self.order[lo:hi, f]
        for _, f, lo, hi in ranges[1:]:
            inside = np.zeros(len(self.rows), bool)
            inside[self.order[lo:hi, f]] = True
            found = found[inside[found]]
        return found


def buckets(rows: np.ndarray) -> list[Bucket]:
    """Length buckets, longest rows first."""
    lengths = np.sqrt((rows * rows).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    return [Bucket(rows[at], at, lengths[at]) for at in np.split(order, range(ROWS_A_BUCKET, len(order), ROWS_A_BUCKET)) if len(at)]


def _first(score: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int):
    """The k best by score, then id, of the rows ``at``."""
    best = np.lexsort((ids[at], -score))[:k]
    return score[best], at[best]


def bands(held: list[Bucket], ids: np.ndarray, fit: np.ndarray, query: np.ndarray, low: list[int], high: list[int], k: int):
    """For every band ``[low, high]`` of scores the k best rows in it, among
    the rows for which ``fit``: a list of (scores, places)."""
    length = math.sqrt(float(query @ query))
    direction = query / max(length, 1.0)
    focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
    found = [(np.empty(0), np.empty(0, np.int64)) for _ in low]
    for bucket in held:
        # the least score that can still change a band
        wanted = min(max(lo, s[k - 1]) if len(s) >= k else lo for lo, (s, _) in zip(low, found))
        reach = length * bucket.longest
        if wanted > reach * (1 + SLACK) + SLACK:
            break
        if wanted > 0 and reach > 0:
            here = bucket.candidates(direction, focus, wanted / reach - SLACK)
        else:  # no angle is ruled out
            here = np.arange(len(bucket.rows))
        here = here[fit[bucket.places[here]]]
        score = bucket.rows[here] @ query
        for i, (lo, hi) in enumerate(zip(low, high)):
            inside = (score >= lo) & (score <= hi)
            if inside.any():
                s = np.concatenate([found[i][0], score[inside]])
                at = np.concatenate([found[i][1], bucket.places[here[inside]]])
                found[i] = _first(s, ids, at, k)
    return found


def _bands_exact(rows, ids, fit, query, low, high, k):
    """The same for integers that doubles do not hold."""
    score = [max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(r, query)))) for r in rows]
    out = []
    for lo, hi in zip(low, high):
        order = sorted((-s, int(ids[i]), i) for i, s in enumerate(score) if fit[i] and lo <= s <= hi)[:k]
        out.append(([-s for s, _, _ in order], [i for _, _, i in order]))
    return out


def _search(k: int, scale: float, same_label: bool):
    """Anchors (key, id, label, vector, slots, low, high) against rows (id,
    label, vector): the k best of every band."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"key": [], "slot": [], "found_id": [], "score": []}
        if left.num_rows and right.num_rows:
            dim = left["dim"][0].as_py()
            asks, big_asks = _integers(left["vector"], dim, scale)
            rows, big_rows = _integers(right["vector"], dim, scale)
            ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
            small = asks is not None and rows is not None
            held = buckets(rows) if small else None
            if not small:
                asks, rows = ([[int(v) for v in r] for r in x.tolist()] if x is not None else big
                              for x, big in ((asks, big_asks), (rows, big_rows)))
            for i, (key, own, label, slots, low, high) in enumerate(zip(*(
                    left[c].to_pylist() for c in ("key", "id", "label", "slots", "low", "high")))):
                fit = (ids != own) & ((labels == label) == same_label)
                found = (bands(held, ids, fit, asks[i], low, high, k) if small
                         else _bands_exact(rows, ids, fit, asks[i], low, high, k))
                for slot, (score, at) in zip(slots, found):
                    out["key"] += [key] * len(at)
                    out["slot"] += [slot] * len(at)
                    out["found_id"] += ids[at].tolist() if len(at) else []
                    out["score"] += [int(s) for s in score]
        return pa.table({"key": pa.array(out["key"], pa.int64()), "slot": pa.array(out["slot"], pa.int32()),
                         "found_id": pa.array(out["found_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})
    return run


def _nearest(asks: DataFrame, rows: DataFrame, by: list[str], k: int, scale: float, same_label: bool) -> DataFrame:
    """(key, slot, found_id, score, rank): groups meet on the columns ``by``."""
    cells = asks.dropDuplicates(["key"]).agg(F.sum("dim")).first()[0] or 0
    turns = max(1, -(-cells // CELLS))
    turn = F.pmod(F.xxhash64("key"), F.lit(turns)).cast("int")
    every_turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))
    # both sides come from one table: columns of their own
    left = asks.select(*[F.col(c).alias(c) for c in asks.columns], turn.alias("turn"))
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns], every_turn.alias("turn"))
    near = left.groupBy(*by, "turn").cogroup(right.groupBy(*by, "turn")).applyInArrow(
        _search(k, scale, same_label), "key long, slot int, found_id long, score long")
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "found_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _parts(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many groups of bounded size the rows of each value of ``by`` (its
    first column is ``dim``) need, and the longest vector among them."""
    return materialize(rows.groupBy(*by).agg(
        F.ceil(F.count("*") * F.col("dim") / CELLS).cast("int").alias("parts"), F.max("length").alias("longest")), name)


def _small(table: DataFrame) -> DataFrame:
    """Broadcast, if the written ``table`` is small; else Spark's choice."""
    return F.broadcast(table) if table.count() <= SMALL_TABLE else table


def _part_of(rows: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the number of parts; only values of ``by`` with several
    parts are looked up (at most one in CELLS components)."""
    several = _small(parts.where("parts > 1").select(*by, "parts"))
    return rows.join(several, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _dealt(rows: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """The rows with the number of their group; repeated rows spread as well."""
    return _part_of(rows, parts, by).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).select(
        *by, "part", "id", *(["label"] if "label" not in by else []), "vector")


def every_part() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("parts") - 1))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score, positive_rank) of every row for which ``is_anchor``.  A
    negative's score is between ``least`` and ``most`` percent of the
    positive's (0 to 100)."""
    if not 0 <= least <= most <= 100:
        raise ValueError("wanted: 0 <= least <= most <= 100")
    rows = vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.size(vector_col).alias("dim"),
        F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("asks"))
    # an upper bound of the integers' length: one unit for each floor
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * F.lit(float(scale)) + 1, F.lit(2.0))))
    rows = materialize(rows.where("label IS NOT NULL AND dim > 0").withColumn("length", length).withColumn(
        "row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where("asks").withColumn("key", F.xxhash64("id", "label", "vector")).dropDuplicates(["key", "id"]).select(
        "key", "id", "label", "dim", "vector", "length")

    # positives: groups within a label; one band that holds every score
    by = ["dim", "label"]
    parts = _parts(rows, by, "labels")
    own = _part_of(anchors, parts, by).withColumn("part", every_part()).select(
        *by, "part", "key", "id", "vector", F.array(F.lit(0)).alias("slots"),
        F.array(F.lit(-(2**63))).alias("low"), F.array(F.lit(2**63 - 1)).alias("high"))
    near = materialize(_nearest(own, _dealt(rows, parts, by), [*by, "part"], positives, scale, True), "positives")

    # the bands of each anchor's positives; a negative score has none
    wanted = near.where("score >= 0").select(
        "key", F.struct(F.col("rank").alias("slot"), _ceil_share("score", least).alias("low"), _floor_share("score", most).alias("high")).alias("band"))
    wanted = wanted.where("band.low <= band.high").groupBy("key").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    asks = anchors.join(wanted, "key").withColumn("least", F.array_min(F.col("bands.low")))

    # negatives: groups of similar length that can reach the least wanted score
    edges = rows.agg(F.percentile_approx("length", [i / LENGTH_CLASSES for i in range(1, LENGTH_CLASSES)])).first()[0] or []
    classed = rows.withColumn("class", sum([(F.col("length") > e).cast("int") for e in sorted(set(edges))], F.lit(0)))
    by = ["dim", "class"]
    parts = _parts(classed, by, "lengths")
    sent = asks.join(_small(parts), "dim").where(F.col("least") <= F.col("length") * F.col("longest")).withColumn("part", every_part()).select(
        *by, "part", "key", "id", "label", "vector", F.col("bands.slot").alias("slots"), F.col("bands.low").alias("low"), F.col("bands.high").alias("high"))
    far = _nearest(sent, _dealt(classed, parts, by), [*by, "part"], negatives, scale, False)

    pairs = anchors.select("key", F.col("id").alias("anchor_id")).join(
        near.select("key", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "key")
    return far.join(pairs, ["key", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"), F.col("slot").alias("positive_rank"))


def _ceil_share(score: str, percent: int) -> Column:
    """The least s with percent * score <= 100 * s; score is not negative."""
    return F.expr(f"CAST((CAST({percent} AS DECIMAL(5, 0)) * {score} + 99) DIV 100 AS BIGINT)")


def _floor_share(score: str, percent: int) -> Column:
    """The largest s with 100 * s <= percent * score; score is not negative."""
    return F.expr(f"CAST((CAST({percent} AS DECIMAL(5, 0)) * {score}) DIV 100 AS BIGINT)")
