"""The severity scorer and the cut, written again in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from scribeval.llm import toxicity, words
from scribeval.sources.tables import table_path

MASK = (1 << 64) - 1


def finalise(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def word_hash(word):
    total = sum((b + 1) * pow(words.BYTE_BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word) * words.WORD_BASE
    return finalise(total & MASK)


def places(text, bits):
    raw = bytes(b + 32 if 65 <= b <= 90 else 32 if 33 <= b < 127 and not chr(b).isalnum() else b for b in (text or "").encode())
    out = set()
    for w in raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").split():
        out.add(word_hash(w) >> (64 - bits))
        for n in toxicity.PREFIXES:
            if len(w) > n:
                out.add((word_hash(w[:n]) * (2 * n + 1) & MASK) >> (64 - bits))
    return out


def judged(text, m):
    weight = dict(zip(m.places.tolist(), m.weights.tolist()))
    margin = sum(weight.get(p, 0.0) for p in places(text, m.bits))
    at_least = [1 / (1 + math.exp(-(margin - t))) for t in m.thresholds]
    edges = [1.0, *at_least, 0.0]
    shares = [a - b for a, b in zip(edges, edges[1:])]
    return sum(at_least), shares.index(max(shares))


def best_cut(severity, positive, precision):
    best, out = -1.0, None
    order = sorted(set(severity), reverse=True)
    for i, s in enumerate(order):
        said = [p for x, p in zip(severity, positive) if x >= s]
        hits = sum(said)
        value = 2 * hits / (len(said) + sum(positive)) * min(hits / len(said) / precision, 1.0)
        if value > best + 1e-15:
            best, out = value, (s + order[i + 1]) / 2 if i + 1 < len(order) else s / 2
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(table_path(sf, t)) for t in ("documents", "labels"))
    return docs, toxicity.fit(docs, labels)


def test_every_row_equals_the_plain_scorer(fitted):
    docs, m = fitted
    rows = toxicity.score(docs.select("doc_id", "text"), m).collect()
    assert len(rows) == 1000 and sum(r.toxic for r in rows) > 10
    for r in rows:
        severity, grade = judged(r.text, m)
        assert r.severity == pytest.approx(severity, rel=1e-4, abs=1e-5)  # weights are looked up as 32-bit floats
        assert r.grade == grade and r.toxic == (r.severity >= m.cut)


def test_cut_equals_the_definition():
    import numpy as np
    r = np.random.default_rng(4)
    for n, share in ((30, 0.3), (200, 0.1), (200, 0.02), (50, 0.9)):
        positive = r.random(n) < share
        if not positive.any():
            positive[0] = True
        severity = np.round(np.where(positive, 1.2, 0.4) + r.normal(0, 0.5, n), 1)
        assert toxicity._best_cut(severity, positive, 0.9) == pytest.approx(best_cut(severity.tolist(), positive.tolist(), 0.9))


def test_rows_that_chose_nothing(spark):
    """Precision and recall on labels that neither features, nor grades, nor
    the cut have seen."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(table_path(sf, t)) for t in ("documents", "labels"))
    seen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, labels.where(seen))
    held = docs.join(labels.where(~seen).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    rows = [(r.toxic, r.label == 1) for r in toxicity.score(held.select("doc_id", "text", "label"), model).collect()]
    hits, said, toxic = (sum(f(a, b) for a, b in rows) for f in (lambda a, b: a and b, lambda a, b: a, lambda a, b: b))
    print(f"held out: {hits} of {said} rejections right, {hits} of {toxic} toxic found, {len(rows)} rows")
    assert hits / said >= 0.8 and hits / toxic >= 0.6


def test_a_repeated_id_keeps_the_bound(spark):
    base = [(i, f"clean words number {i % 50} here", 0) if i % 4 else (i, f"awful nasty vile slur {i % 50}", 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in base] + [(4, f"awful nasty vile slur again {k}") for k in range(2000)] + [(8, "same")] * 500,
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in base], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, max_rows=400)
    assert 250 <= m.cross_validated["rows"] <= 600
    found = {r.doc_id for r in toxicity.score(docs, m).where("toxic").collect()}
    assert 0 in found and 1 not in found
