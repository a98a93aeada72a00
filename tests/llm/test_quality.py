"""The compression classifier: held-out accuracy, calibration, edge rows."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from scribeval.llm import quality, queries

SF = "/root/testdata/sf0.01"
GOOD = "the quiet river runs under an old bridge while people walk home in the evening light".split()
BAD = "BUY!! CHEAP!! $$$ click### here%%% now&&& | win*** free!! offer### ***".split()


def _text(r, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(r.randint(20, 200)))


def _rows(n, seed):
    r = random.Random(seed)
    return [(i, _text(r, GOOD if i % 3 else BAD), int(i % 3 > 0)) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _rows(400, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    return docs, labels, quality.fit(docs, labels, ~quality.held_out(F.col("doc_id")))


def test_query_separates_held_out_rows(spark):
    got = queries.op12_quality_classifier(spark, SF).toPandas()
    want = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IN (0, 1)").df()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(want, on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    above = (good.to_numpy()[:, None] > bad.to_numpy()).mean() + 0.5 * (good.to_numpy()[:, None] == bad.to_numpy()).mean()
    assert above > 0.9 and (held.predicted == held.quality).mean() > 0.9


def test_scores_equal_a_plain_rewrite(fitted):
    _, _, m = fitted
    r = random.Random(5)
    texts = [_text(r, GOOD), _text(r, BAD), "", None, "x", _text(r, GOOD + BAD) * 40]
    sizes = []
    for content in (m.bad, m.good):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content),
                                     write_checksum=False, write_content_size=False, write_dict_id=False)
        raw = [(t or "").encode() for t in texts]
        sizes.append([sum(len(c.compress(b[i:i + quality.PART])) for i in range(0, len(b), quality.PART)) for b in raw])
    want = [(a - b) / (len((t or "").encode()) + quality.SHORT) for a, b, t in zip(*sizes, texts)]
    assert quality.figures(pa.array(texts, pa.string()), m.bad, m.good).tolist() == pytest.approx(want)


def test_labels_of_held_out_rows_are_not_learnt(spark, fitted):
    docs, labels, m = fitted
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality.fit(docs, turned, ~quality.held_out(F.col("doc_id")))
    assert (m.good, m.bad) == (other.good, other.bad) and m.scores.tolist() == other.scores.tolist()


def test_unseen_texts(spark, fitted):
    _, _, m = fitted
    rows = _rows(90, 77)
    frame = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(frame, m).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(q) for i, _, q in rows]) > 0.97


def test_calibration_is_isotonic():
    x = np.array([0.0, 1, 2, 3, 4, 5])
    at, share = quality.calibrate(x, np.array([0, 1, 0, 0, 1, 1]))
    assert (np.diff(share) >= 0).all() and (np.diff(at) > 0).all() and 0 < share[0] < 0.5 < share[-1] < 1
    r = np.random.default_rng(0)
    x = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x))).astype(int)
    at, share = quality.calibrate(x, y)
    assert abs(np.interp(x, at, share) - 1 / (1 + np.exp(-2 * x))).mean() < 0.05


def test_edge_rows(spark, fitted):
    docs, labels, m = fitted
    odd = spark.createDataFrame([(None, None, "7"), (1, "", "8"), (1, "", "8"), (2, "x" * 3_000_000, None)],
                                "doc_id long, text string, score string").withColumn("a.b", F.lit(1))
    out = quality.score(odd, m)
    assert sorted(out.columns) == sorted(odd.columns) and dict(out.dtypes)["score"] == "double"
    assert out.count() == 4 and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(odd.limit(0), m).count() == 0
    # no labels, one class, labels without documents, odd labels
    every = F.lit(True)
    none = quality.fit(docs, labels.limit(0), every)
    assert quality.score(odd, none).where("score <> 0.5").count() == 0
    assert quality.score(odd, quality.fit(docs, labels.where("quality = 1"), every)).where("score <> 1").count() == 0
    strange = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (6, 2), (10**9, 0)], "doc_id long, quality int"))
    assert quality.fit(docs, strange, every).scores.tolist() == quality.fit(docs, labels, every).scores.tolist()


def test_one_id_with_many_rows_keeps_the_bound(spark, fitted):
    """A third of the documents share an id: the sample stays bounded."""
    docs, labels, _ = fitted
    many = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("river bridge "), F.col("id").cast("string")).alias("text"))
    every = docs.unionByName(many)
    m = quality.fit(every, labels, F.lit(True), max_rows=300, max_pieces=200)
    assert len(m.figures) <= 400 and m.good and m.bad
