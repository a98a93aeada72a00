import numpy as np
import pytest
from pyspark.sql import functions as F

from scribeval.operators import quantile
from scribeval.operators.quantile import exact_percentile, merged_sketches, quantile_sketches, sketched_quantile


def _frame(spark, groups):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "k string, v double").repartition(6)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 0.999, 1.0])
def test_equal_to_numpy_on_distinct_values(spark, p):
    r = np.random.default_rng(1)
    groups = {
        "even": r.random(5000), "tail": np.exp(r.normal(size=4000) * 8), "signs": r.normal(size=3001) * 1e-9, "two": [3.0, 4.0],
        "one": [7.5], "same": [2.0] * 50, "near": 1.0 + r.random(2000) * 1e-13, "wide": r.choice([-1.0, 1.0], 999) * 10.0 ** r.uniform(-300, 300, 999),
        "ties": r.integers(0, 5, 1000), None: r.random(100),
    }
    got = {r.k: r.p for r in exact_percentile(_frame(spark, groups), "v", ["k"], p, "p").collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k] == pytest.approx(np.percentile(values, p * 100), rel=1e-9, abs=0), k


def test_infinite_and_missing_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 1.0), ("a", inf), ("a", 2.0), ("b", nan), ("b", 1.0), ("b", 3.0), ("c", None), ("d", -inf), ("d", 0.0), ("d", 5.0), ("d", inf)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.p for r in exact_percentile(df, "v", ["k"], 0.5, "p").collect()}
    assert got == {"a": 2.0, "b": 3.0, "d": 2.5}
    assert exact_percentile(df.limit(0), "v", ["k"], 0.5, "p").count() == 0


def test_rounds_look_only_inside_the_bracket(spark, monkeypatch):
    """Few rounds, and no window over values."""
    tables = []
    kept = quantile.materialize

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan or "[v#" not in plan.split("Window", 1)[1].split("\n", 1)[0]
        tables.append(name)
        return kept(df, name)
    monkeypatch.setattr(quantile, "materialize", counted)
    r = np.random.default_rng(2)
    values = 10.0 ** r.uniform(-5, 5, 20_000)
    got = exact_percentile(_frame(spark, {"x": values}), "v", ["k"], 0.95, "p").first().p
    assert got == pytest.approx(np.percentile(values, 95), rel=1e-12) and len(tables) <= 4


def test_sketches_add_up(spark):
    r = np.random.default_rng(3)
    values = r.exponential(size=30_000)
    df = spark.createDataFrame([(f"d{i % 7}", float(v)) for i, v in enumerate(values)], "dataset string, v double").repartition(5)
    each = quantile_sketches(df.union(spark.createDataFrame([("d0", None)], df.schema)), "v", ["dataset"])
    assert each.count() == 7 and each.select(F.max(F.length("sketch"))).first()[0] < 8000
    for p in (0.05, 0.5, 0.95):
        got = merged_sketches(each, []).select(sketched_quantile("sketch", p).alias("q")).first().q
        assert abs((values <= got).mean() - p) < 0.03
