"""Hard negatives against brute force, ties, hot labels and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribeval.llm import hard_negatives as hn


def brute(rows, anchors, positives=5, negatives=10, least=30, most=90, scale=256):
    """rows: (id, label, vector); the anchors are places of rows."""
    ok = [(i, l, [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in v]) for i, l, v in rows
          if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for a in anchors:
        if a not in ok and (a[0], a[1]) is None:
            continue
        own, label, vector = a
        if (own, label, tuple(vector)) in seen:
            continue
        seen.add((own, label, tuple(vector)))
        clamp = lambda s: max(-2**63, min(2**63 - 1, s))
        score = [(clamp(sum(x * y for x, y in zip(v, vector))), i, l) for i, l, v in ok if i != own and len(v) == len(vector)]
        near = sorted((-s, i) for s, i, l in score if l == label)[:positives]
        for p, (ps, pid) in enumerate(near, 1):
            ps = -ps
            far = sorted((-s, i) for s, i, l in score if l != label and least * ps <= 100 * s <= most * ps)[:negatives]
            out += [(own, pid, r, i, ps, -s, p) for r, (s, i) in enumerate(far, 1)]
    return sorted(out)


def ints(row, scale=256):
    return (row[0], row[1], [math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale for x in row[2]])


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    out = hn.mine(frame, F.col("vec_id") % 10 == 0, F.col("label"), **more)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect()))


def clustered(n, dim, labels, seed, spread=0.6, hot=None):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    out = []
    for i in range(n):
        v = centres[i % 5] + spread * r.normal(size=dim)
        v = v / np.linalg.norm(v) * r.choice([0.1, 1.0, 3.0])
        label = hot if hot is not None and i % 3 == 0 else int(r.integers(labels))
        out.append((i, label, v.tolist()))
    return out


@pytest.mark.parametrize("dim,labels", [(8, 3), (64, 10), (1, 2), (3, 1)])
def test_equal_to_brute_force(spark, dim, labels):
    rows = clustered(400, dim, labels, dim)
    want = brute(rows, [ints(r) for r in rows if r[0] % 10 == 0])
    assert run(spark, rows) == want and (labels == 1 or want)


def test_many_small_groups_and_buckets(spark, monkeypatch):
    """Hot labels, several groups, blocks and buckets: same rows."""
    monkeypatch.setattr(hn, "CELLS", 16 * 40)
    monkeypatch.setattr(hn, "SMALL_TABLE", 0)
    rows = clustered(500, 16, 4, 9, hot=2)
    assert run(spark, rows) == brute(rows, [ints(r) for r in rows if r[0] % 10 == 0])


def test_buckets_hold_the_k_best_of_each_band(monkeypatch):
    monkeypatch.setattr(hn, "ROWS_A_BUCKET", 32)
    r = np.random.default_rng(3)
    rows = np.floor(256 * r.normal(size=(600, 12)) * r.choice([0.1, 1, 2], size=(600, 1)))
    ids = r.permutation(600)
    held, looked = hn.buckets(rows), 0
    for q in rows[:40]:
        score = rows @ q
        top = int(score.max())
        low, high = [int(0.6 * top), int(0.3 * top), -(2**63)], [int(0.9 * top), int(0.5 * top), 2**63 - 1]
        fit = np.ones(600, bool)
        for (s, at), lo, hi in zip(hn.bands(held, ids, fit, q, low, high, 7), low, high):
            want = sorted((-x, int(i)) for x, i in zip(score, ids) if lo <= x <= hi)[:7]
            assert [(-x, int(ids[j])) for x, j in zip(s, at)] == want
        unit = q / np.linalg.norm(q)
        focus = np.argsort(-abs(unit), kind="stable")[:hn.FOCUS]
        for b in held:  # no row above the bound is pruned, and some rows are
            found = set(b.candidates(unit, focus, 0.8).tolist())
            lengths = np.sqrt((b.rows ** 2).sum(axis=1))
            assert {i for i in range(len(b.rows)) if b.rows[i] @ unit >= 0.8 * lengths[i]} <= found
            looked += len(found)
    assert looked < 0.3 * 40 * 600


def test_ties_and_repeated_rows(spark):
    rows = [(i, i % 2, [1.0, 0.5]) for i in range(30)] + [(i, 0, [1.0, 0.5]) for i in range(3)] * 2
    rows += [(40 + i, 1, [0.5, 0.25]) for i in range(25)] + [(40, 1, [0.5, 0.25])] * 2
    assert run(spark, rows) == brute(rows, [ints(r) for r in rows if r[0] % 10 == 0])


def test_zero_and_opposite_vectors(spark):
    rows = [(0, 1, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (2, 2, [0.0, 0.0]), (3, 2, [1.0, 1.0]), (10, 3, [1.0, 0.0]), (11, 3, [-1.0, 0.0]),
            (20, 4, [1.0, 0.0]), (21, 4, [0.0, 1.0]), (22, 5, [0.0, -3.0])]
    assert run(spark, rows) == brute(rows, [ints(r) for r in rows if r[0] % 10 == 0])


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = clustered(60, 4, 2, 5)
    odd = [(None, 1, [1.0] * 4), (70, None, [1.0] * 4), (71, 1, None), (72, 1, []), (73, 1, [1.0, None, 1.0, 1.0]),
           (80, 1, [nan, 1.0, 1.0, 1.0]), (81, 0, [inf, 1.0, 1.0, 1.0]), (90, 1, [1.0, 2.0]), (91, 1, [1.0, 2.0]), (92, 0, [0.5, 1.0])]
    rows = good + odd
    anchors = [ints(r) for r in good + odd[-3:] if r[0] % 10 == 0]
    assert run(spark, rows) == brute(rows, anchors)
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hn.mine(none, F.lit(True), F.col("label")).count() == 0


def test_huge_components(spark):
    rows = [(0, 0, [1e30, 2.0]), (1, 0, [1e30, 1.0]), (2, 1, [1e3, 1e3]), (3, 1, [4e29, 0.0]), (10, 0, [1e5, 3.5]), (11, 0, [2e5, 0.1]),
            (12, 1, [1e5, 0.25]), (13, 1, [1.5, 0.25])]
    assert run(spark, rows) == brute(rows, [ints(r) for r in rows if r[0] % 10 == 0])


def test_clashing_columns(spark):
    rows = clustered(80, 4, 3, 6)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr(
        "*", *[f"'x' AS `{c}`" for c in ("id", "key", "part", "class", "length", "vector", "row", "slot", "score", "rank", "a.b")])
    out = hn.mine(frame, F.col("vec_id") % 10 == 0, F.col("label"))
    assert out.count() == len(brute(rows, [ints(r) for r in rows if r[0] % 10 == 0]))
