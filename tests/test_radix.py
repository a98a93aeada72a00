import hashlib

import pytest
from pyspark.sql import functions as F

from scribeval.operators import radix
from scribeval.operators.radix import hash_row_number, kth_key
from scribeval.operators.sampling import shuffle_split, train_split


def _keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long").repartition(5).withColumn("key", F.md5(F.col("id").cast("string")))


def _sorted(ids):
    return sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in ids)


@pytest.mark.parametrize("fetched", [0, 3, 1000])
def test_kth_key_is_exact(spark, monkeypatch, fetched):
    """With one hexadecimal digit a level several levels are needed."""
    monkeypatch.setattr(radix, "DIGITS", 1)
    monkeypatch.setattr(radix, "FETCHED", fetched)
    df = _keys(spark, range(700))
    want = _sorted(range(700))
    for k in (1, 2, 333, 490, 699, 700):
        got = kth_key(df, "key", "id", lambda n, k=k: F.lit(k).cast("long"))
        assert (got.n, got.k, (got.key, got.id)) == (700, k, want[k - 1])
        assert df.where(got.reached_by("key", "id")).count() == k


def test_no_rows_and_one_row(spark):
    assert kth_key(_keys(spark, [1]).limit(0), "key", "id", lambda n: F.greatest(F.lit(1).cast("long"), n)).key is None
    one = train_split(_keys(spark, [9]).select(F.col("id").alias("sample_id")))
    assert [r.split for r in one.collect()] == ["train"]


@pytest.mark.parametrize("n", [1, 500, 10**6])
def test_row_numbers(spark, n):
    got = {r.id: r.rn for r in hash_row_number(_keys(spark, range(400)), "key", "id", n).collect()}
    assert got == {i: k for k, (_, i) in enumerate(_sorted(range(400)), 1)}


def test_split_is_the_same_with_and_without_ranks(spark):
    df = spark.range(3000).select(F.col("id").alias("sample_id"), F.lit("d").alias("dataset"))
    ranked = {r.sample_id: (r.split, r.shuffle_rank, r.audio_id) for r in shuffle_split(df).collect()}
    plain = train_split(df)
    assert {r.sample_id: r.split for r in plain.collect()} == {k: v[0] for k, v in ranked.items()}
    assert sum(v[0] == "train" for v in ranked.values()) == 2100
    assert sorted(v[1] for v in ranked.values()) == list(range(1, 3001)) and all(v[2] == v[1] - 1 for v in ranked.values())
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
