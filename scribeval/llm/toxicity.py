"""Toxicity by cumulative-link ordinal regression on sparse text features.

Model: severity grades 0 < 1 < ... < K-1 with
``P(grade >= k) = sigmoid(x.w - t_k)``: one weight vector ``w`` shared by all
ordered thresholds ``t_1 < t_2 < ...``.  The expected severity is the sum of
these probabilities.  Features are the words of a text (ASCII case folded,
punctuation dropped) and their first 4, 5 and 6 bytes, hashed to ``2**bits``
places and counted once per text, so a stem with ever new endings is seen.

Fitting (Spark does the counting; the sample bound is a parameter):

1. about ``max_rows`` labelled texts, those with the smallest hash of the id,
   are joined from the documents; where ids repeat, repeated rows count once and
   the bound holds for the rows that are left, by their hashes;
2. document frequencies of every feature per class, summed in Spark, give a
   log-odds z-score; the ``n_features`` with the largest are kept;
3. where labels are binary, positives are split into ``levels - 1`` grades
   by how many tell-tale features they hold (quantiles among positives);
4. one task fits weights and thresholds on the kept features of the sample,
   and again without each fifth of either class in turn, which gives every
   row a severity by a model that was not fitted on it; the rejection cut is
   the one with the best F1 on these severities, lessened in proportion where
   less than the wanted precision of its rejections are right (midway between
   the classes where they separate).  It is always finite.

Scoring is one Arrow function over all whole texts; nothing is shuffled.

Edge cases: labels that are null or have no document are ignored; without
both classes the model is empty and rejects nothing.  A null or empty text
has no features: its severity comes from the thresholds alone.  Ties of the
severity with the cut are rejected.  Repeated rows are scored alike; other
columns are carried along and columns named like a result are replaced.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ASCII_LOWER, text_buffer, text_slices, word_hashes, word_spans

PREFIXES = (4, 5, 6)
RESULT = ("severity", "grade", "toxic")
SPACE = 1 << 62

#: Bytes as the features see them: A-Z folded, ASCII punctuation as a blank.
_FOLD = ASCII_LOWER.copy()
for _b in range(0x21, 0x7F):
    if not chr(_b).isalnum():
        _FOLD[_b] = 0x20


@dataclass
class Model:
    """``weights[i]`` belongs to the feature place ``places[i]``."""
    bits: int
    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float
    cross_validated: dict

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Weight of every place, and which places have one (made once)."""
        if not hasattr(self, "_lookup"):
            weight, wanted = np.zeros(1 << self.bits, np.float32), np.zeros(1 << self.bits, bool)
            weight[self.places] = self.weights
            wanted[self.places] = True
            self._lookup = weight, wanted
        return self._lookup

    def severity(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and the most probable grade."""
        if not len(self.thresholds):
            return np.zeros(len(margin)), np.zeros(len(margin), np.int32)
        at_least = _sigmoid(margin[:, None] - self.thresholds[None, :])
        edge = np.concatenate([np.ones((len(margin), 1)), at_least, np.zeros((len(margin), 1))], axis=1)
        return at_least.sum(axis=1), np.argmax(edge[:, :-1] - edge[:, 1:], axis=1).astype(np.int32)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _places(buf: np.ndarray, offsets: np.ndarray, bits: int):
    """(text, feature place) of all words, features repeated as they occur."""
    folded = _FOLD[buf]
    starts, ends, first = word_spans(folded, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole, *cuts = word_hashes(folded, starts, ends, PREFIXES)
    shift = np.uint64(64 - bits)
    yield doc, (whole >> shift).astype(np.int64)
    for n, h in zip(PREFIXES, cuts):
        longer = (ends - starts) > n
        yield doc[longer], (h[longer] * np.uint64(2 * n + 1) >> shift).astype(np.int64)


def _distinct(buf, offsets, bits, wanted=None):
    """Distinct (text, place) of a batch; only places with ``wanted``."""
    found = []
    for doc, place in _places(buf, offsets, bits):
        if wanted is not None:
            hit = wanted[place]
            doc, place = doc[hit], place[hit]
        found.append((doc << bits) | place)
    both = np.unique(np.concatenate(found))
    return both >> bits, both & ((1 << bits) - 1)


def _counts(bits: int, slices: int):
    width = (1 << bits) // slices

    def run(batches):
        counts = np.zeros((2, 1 << bits), np.uint32)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            positive = batch["grade"].to_numpy(zero_copy_only=False) > 0
            docs += [(~positive).sum(), positive.sum()]
            buf, offsets = text_buffer(batch["text"])
            for lo, hi in text_slices(offsets):
                doc, place = _distinct(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], bits)
                for side in (0, 1):
                    np.add.at(counts[side], place[positive[lo:hi][doc] == side], np.uint32(1))
        for s in range(slices):
            part = counts[:, s * width:(s + 1) * width]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "n0": [int(docs[0])], "n1": [int(docs[1])],
                                              "c0": [part[0].tobytes()], "c1": [part[1].tobytes()]})
    return run


def _choose(bits: int, slices: int, n_features: int, least_z: float):
    width = (1 << bits) // slices

    def run(table: pa.Table) -> pa.Table:
        n0, n1 = sum(table["n0"].to_pylist()), sum(table["n1"].to_pylist())
        b, a = (sum(np.frombuffer(x, np.uint32).astype(np.float64) for x in table[c].to_pylist()) for c in ("c0", "c1"))
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        z[(a + b) < 3] = 0
        best = np.argsort(-np.abs(z), kind="stable")[:n_features]
        best = best[np.abs(z[best]) >= least_z]
        return pa.table({"place": pa.array(best + table["slice"][0].as_py() * width, pa.int64()), "z": z[best]})
    return run


def _kept(bits: int, places: np.ndarray):
    wanted = np.zeros(1 << bits, bool)
    wanted[places] = True

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch["text"])
            for lo, hi in text_slices(offsets):
                doc, place = _distinct(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], bits, wanted)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_pydict({
                    "key": batch["key"][lo:hi], "grade": batch["grade"][lo:hi],
                    "places": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int64()))})
    return run


def fit_cumulative_link(row: np.ndarray, col: np.ndarray, n_cols: int, grades: np.ndarray, levels: int,
                        steps: int = 300, rate: float = 0.1, ridge: float = 1e-3):
    """Weights and ordered thresholds by full-batch Adam on the penalised
    log-likelihood; (row, col) are the set cells of a 0/1 matrix."""
    n = len(grades)
    share = np.array([(grades >= k).mean() for k in range(1, levels)])
    t = np.maximum.accumulate(-np.log((share + 1e-3) / (1 - share + 1e-3)))
    # t_1 and the logs of the gaps above it: thresholds stay in order
    params = np.concatenate([np.zeros(n_cols), t[:1], np.log(np.diff(t) + 0.1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, base, gaps = params[:n_cols], params[n_cols], np.exp(params[n_cols + 1:])
        cuts = base + np.concatenate([[0.0], np.cumsum(gaps)])
        margin = np.bincount(row, weights=w[col], minlength=n)
        upper = np.concatenate([np.ones((n, 1)), _sigmoid(margin[:, None] - cuts)], axis=1)
        lower = np.concatenate([upper[:, 1:], np.zeros((n, 1))], axis=1)
        at = np.arange(n), grades
        p = np.maximum(upper[at] - lower[at], 1e-12)
        d_up = upper[at] * (1 - upper[at])
        d_low = lower[at] * (1 - lower[at])
        d_margin = -(d_up - d_low) / p / n
        d_cut = np.zeros(levels - 1)
        np.add.at(d_cut, np.maximum(grades - 1, 0), np.where(grades > 0, d_up / p, 0.0) / n)
        np.add.at(d_cut, np.minimum(grades, levels - 2), np.where(grades < levels - 1, -d_low / p, 0.0) / n)
        grad = np.concatenate([
            np.bincount(col, weights=d_margin[row], minlength=n_cols) + ridge * w,
            [d_cut.sum()], d_cut[1:][::-1].cumsum()[::-1] * gaps])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params = params - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    gaps = np.exp(params[n_cols + 1:])
    return params[:n_cols], params[n_cols] + np.concatenate([[0.0], np.cumsum(gaps)])


def _best_cut(severity: np.ndarray, positive: np.ndarray, precision: float) -> float:
    """The cut with the best F1, which counts in proportion where less than
    ``precision`` of the rejections are right, midway between its neighbours."""
    order = np.argsort(-severity, kind="stable")
    s, hit = severity[order], np.cumsum(positive[order])
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    f1 = 2 * hit[ends] / (ends + 1 + positive.sum())
    best = ends[int(np.argmax(f1 * np.minimum(hit[ends] / (ends + 1) / precision, 1.0)))]
    return float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best] / 2)


def _folds(positive: np.ndarray, most: int = 5) -> np.ndarray:
    """Fold of each row: either class is dealt in turn, so each fold leaves
    rows of both to fit on; all -1 where a class has a single row."""
    n = min(most, int(positive.sum()), int((~positive).sum()))
    fold = np.full(len(positive), -1)
    if n > 1:
        for side in (positive, ~positive):
            fold[side] = np.arange(side.sum()) % n
    return fold


def _train(places: np.ndarray, z: np.ndarray, levels: int, precision: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        grades = table["grade"].to_numpy().astype(np.int64)
        lists = table["places"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(grades)), sizes)
        col = np.searchsorted(places, lists.flatten().to_numpy())
        if grades.max() == 1 and levels > 2:
            telling = np.bincount(row, weights=(z > 0)[col], minlength=len(grades))
            steps = np.quantile(telling[grades > 0], np.arange(1, levels - 1) / (levels - 1))
            grades = np.where(grades > 0, 1 + (telling[:, None] > steps).sum(axis=1), 0)
        top = int(grades.max()) + 1

        def fitted(held: np.ndarray):
            """Weights and thresholds without the held rows, severity of all."""
            renumber = np.cumsum(~held) - 1
            use = ~held[row]
            w, t = fit_cumulative_link(renumber[row[use]], col[use], len(places), grades[~held], top)
            margin = np.bincount(row, weights=w[col], minlength=len(grades))
            return w, t, Model(0, places, w, t, 0.0, {}).severity(margin)[0]

        true = grades > 0
        w, t, severity = fitted(np.zeros(len(grades), bool))
        fold = _folds(true)
        for k in range(fold.max() + 1):
            held = fold == k
            severity[held] = fitted(held)[2][held]
        cut = _best_cut(severity, true, precision)
        said = severity >= cut
        figures = {"rows": len(grades), "toxic": int(true.sum()), "hits": int((said & true).sum()), "said": int(said.sum())}
        return pa.table({"weights": [w.tobytes()], "thresholds": [t.tobytes()], "cut": [cut], "figures": [json.dumps(figures)]})
    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = 20_000, bits: int = 20, n_features: int = 4096, levels: int = 3,
        least_z: float = 3.0, precision: float = 0.9, slices: int = 16) -> Model:
    """Fit on at most ``max_rows`` labelled documents."""
    empty = Model(bits, np.empty(0, np.int64), np.empty(0), np.empty(0), float("inf"), {})
    sample = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("grade"))
              .where("grade >= 0 AND _id IS NOT NULL")
              .select("_id", "grade", F.shiftrightunsigned(F.xxhash64("_id"), 1).alias("key"))
              .orderBy("key", "_id", "grade").limit(max_rows))
    # bounded by max_rows: 20 bytes a row
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(sample), "_id").select("key", "grade", "text")
    if rows.count() > max_rows:  # ids repeat
        named = rows.withColumn("row", F.xxhash64("key", "text"))
        n = named.select("row", "grade").distinct().count()
        kept = named.where(F.pmod(F.xxhash64("row"), F.lit(SPACE)) < F.lit(SPACE if n <= max_rows else int(SPACE * (max_rows / n))))
        rows = kept.groupBy("key", "row", "grade").agg(F.first("text").alias("text")).select("key", "grade", "text")
    counted = rows.select("grade", "text").mapInArrow(
        _counts(bits, slices), "slice int, n0 long, n1 long, c0 binary, c1 binary")
    chosen = (counted.groupBy("slice").applyInArrow(_choose(bits, slices, n_features, least_z), "place long, z double")
              .orderBy(F.abs("z").desc(), "place").limit(n_features).collect())
    if not chosen:
        return empty
    chosen.sort(key=lambda r: r["place"])
    places = np.array([r["place"] for r in chosen], np.int64)
    z = np.array([r["z"] for r in chosen])
    kept = rows.mapInArrow(_kept(bits, places), "key long, grade int, places array<long>")
    fitted = kept.groupBy(F.lit(1).alias("all")).applyInArrow(
        lambda t: _train(places, z, levels, precision)(t) if (t["grade"].to_numpy() > 0).any() and (t["grade"].to_numpy() == 0).any()
        else pa.table({"weights": pa.array([], pa.binary()), "thresholds": pa.array([], pa.binary()),
                       "cut": pa.array([], pa.float64()), "figures": pa.array([], pa.string())}),
        "weights binary, thresholds binary, cut double, figures string").collect()
    if not fitted:
        return empty
    r = fitted[0]
    return Model(bits, places, np.frombuffer(r["weights"]), np.frombuffer(r["thresholds"]), r["cut"], json.loads(r["figures"]))


def _judge(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<severity: double, grade: int, toxic: boolean>")
    def judge(text: pa.Array) -> pa.Array:
        m = shared.value
        weight, wanted = m.lookup()
        buf, offsets = text_buffer(text)
        margin = np.zeros(len(text))
        for lo, hi in text_slices(offsets):
            doc, place = _distinct(buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], m.bits, wanted)
            margin[lo:hi] = np.bincount(doc, weights=weight[place], minlength=hi - lo)
        severity, grade = m.severity(margin)
        return pa.StructArray.from_arrays(
            [pa.array(severity), pa.array(grade, pa.int32()), pa.array(severity >= m.cut)], ["severity", "grade", "toxic"])
    return judge


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade), grade and toxic (rejected)."""
    judge = _judge(docs.sparkSession, model)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in RESULT]
    return docs.select(*keep, judge(F.col(f"`{text_col}`").cast("string")).alias("_judged")).select(
        *keep, *[F.col("_judged")[c].alias(c) for c in RESULT])


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not reject, as they are."""
    return docs.where(~_judge(docs.sparkSession, model)(F.col(f"`{text_col}`").cast("string"))["toxic"])
