import random

import pytest
from pyspark.sql import functions as F

from scribeval.functions.normalize import SPELLINGS
from scribeval.operators.scoring import with_normalized
from scribeval.operators.wordmap import map_words

WORDS = [f"w{i}" for i in range(4000)]


def _table(spark, pairs):
    return spark.createDataFrame(pairs, "word string, replacement string")


def _plain(tokens, table):
    return None if tokens is None else [x for t in tokens for x in table.get(t, t).split() or ([] if t in table else [t])]


@pytest.mark.parametrize("limit", [50_000, 10])
def test_a_table_of_2000_rows_works_like_a_literal_map(spark, limit):
    r = random.Random(1)
    table = {w: r.choice([f"to-{w}", f"two {w} words", ""]) for w in WORDS[:2000]}
    rows = [(i, [r.choice(WORDS[:50] if r.random() < 0.3 else WORDS) for _ in range(r.randint(0, 60))]) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, ["w1"] * 500), (1003, ["w3999"])]
    df = spark.createDataFrame(rows, "k long, tokens array<string>").repartition(4)
    got = {r.k: r.tokens for r in map_words(df, "k", "tokens", _table(spark, list(table.items())), broadcast_rows=limit).collect()}
    assert got == {k: _plain(t, table) for k, t in rows}


def test_join_kind_follows_the_size(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "k long, tokens array<string>")
    table = _table(spark, [("a", "x"), ("b", "y"), ("c", "z")])
    small, large = (map_words(df, "k", "tokens", table, broadcast_rows=n)._jdf.queryExecution().optimizedPlan().toString() for n in (3, 2))
    assert "strategy=broadcast" in small and "strategy=broadcast" not in large and "_salt" in large


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, ["a"], 1), (2, ["a", None, "b"], 2)], "`k.1` long, tokens array<string>, _key int")
    table = _table(spark, [("a", "x"), ("a", "w"), (None, "q"), ("b", None)])
    rows = map_words(df.withColumnRenamed("_key", "other"), "k.1", "tokens", table, out="mapped").collect()
    assert {r["k.1"]: (r.tokens, r.mapped) for r in rows} == {None: (["a"], ["a"]), 2: (["a", None, "b"], ["w", None, "b"])}


def test_spellings_from_a_table_equal_the_built_in_map(spark):
    texts = [(i, " ".join(random.Random(i).choices([a for a, _ in SPELLINGS] + ["the", "one", "st"], k=12))) for i in range(60)]
    df = spark.createDataFrame(texts, "k long, t string")
    want = {r.k: r.n_tokens for r in with_normalized(df, "t", "n").collect()}
    bare = with_normalized(df, "t", "n", spellings=()).select("k", "n_tokens")
    got = {r.k: r.n_tokens for r in map_words(bare, "k", "n_tokens", _table(spark, list(SPELLINGS))).collect()}
    assert got == want


def test_number_words_from_a_table(spark):
    df = spark.createDataFrame([(1, ["a", "dozen", "of", "grand"])], "k long, tokens array<string>")
    row = map_words(df, "k", "tokens", _table(spark, [("dozen", "12"), ("grand", "1000")])).first()
    assert row.tokens == ["a", "12", "of", "1000"]
    assert df.select(F.size("tokens")).first()[0] == 4
