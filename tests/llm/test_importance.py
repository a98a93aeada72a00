"""Importance resampling against brute force, ties and edge rows included."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scribeval.llm import importance
from scribeval.session import materialize

ALPHABET = "abcXYZ019 .,\n\téßñ漢 -  "


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for out, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in buckets_of(text):
                out[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (int(s.sum()) + 10_000) / ((a + 1) * (int(t.sum()) + 10_000))))
            for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for doc_id, text in docs:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found)
        u = (int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        rows.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(u))), len(words_of(text)) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = fit[:percent * len(fit) // 100]
    return rows, drawn


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 600))) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 1 << 10, 300])
def test_features_equal_the_library_hash(monkeypatch, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    rows = ["", "a", "a b", "  ", None, "é", "x" * 700 + " y " + "z" * 300, "Q!" * 5, *texts(60, 1),
            "".join(random.Random(2).choice(ALPHABET) for _ in range(30_000)), "w" * 9000 + " " + "v" * 5000]
    found, words = {i: [] for i in range(len(rows))}, np.zeros(len(rows), int)
    for doc, bucket, lo, n in importance.features(pa.array(rows, pa.string())):
        words[lo:lo + len(n)] += n
        for d, b in zip(doc.tolist(), bucket.tolist()):
            found[lo + d].append(b)
    for i, text in enumerate(rows):
        assert sorted(found[i]) == sorted(buckets_of(text)) and words[i] == len(words_of(text))


@pytest.mark.parametrize("percent", [0, 5, 40, 100])
def test_resample_equals_brute_force(spark, percent):
    docs = list(enumerate(texts(150, 3))) + [(1000, None), (1001, ""), (None, "null id " * 15), (7, "same id, other text " * 9)]
    target = texts(20, 4) + [None, ""]
    frame = spark.createDataFrame([(i, t, "9", "x") for i, t in docs], "doc_id long, text string, rank string, score string").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, wanted, percent=percent).collect()
    rows, drawn = brute(docs, target, percent, 20)
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == sorted((str(r[0]), *r[1:4]) for r in rows)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[3]) for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_repeated_rows_are_drawn_one_by_one(spark):
    """A third of the rows are one document: the cutoff lies inside its ties."""
    docs = [(5, "word " * 30)] * 100 + [(i, f"other words {i} " * 10) for i in range(200, 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = importance.resample(frame, frame.where("doc_id = 5").limit(1), percent=20).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 300 and ranks == list(range(1, 61))
    again = importance.resample(frame, frame.where("doc_id = 5").limit(1), percent=20).collect()
    key = lambda r: (r.doc_id, r.score, r["rank"] or 0)
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("points", [1, 3, 15])
def test_bisection_counts_exactly(spark, points):
    r = random.Random(points)
    values = [r.choice([r.randint(-2**62, 2**62), 7, 7, 8]) for _ in range(200)]
    rows = materialize(spark.createDataFrame([(v,) for v in values], "v long"), "values")
    for need in (1, 2, 50, 111, 200):
        assert importance.bisect(rows, "v", need, points) == sorted(values)[need - 1]


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = frame.limit(0)
    assert importance.resample(none, frame).count() == 0
    row = importance.resample(frame, none, percent=100, least_words=1).first()
    assert row["rank"] == 1 and row.n_features == 6
    assert importance.resample(frame, none, percent=100, least_words=4).where(F.col("rank").isNotNull()).count() == 0
