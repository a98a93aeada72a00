import duckdb
import pytest
from pyspark.sql import functions as F

from scribeval.operators.selection import even_quota, named_dataset, registry_of, resolve_selection, scorable
from scribeval.plans.corpus import ADHOC, load_datasets, scan_entry, src_registry
from scribeval.sources.registry import registry


def _samples(spark, per_ds):
    rows = [(i * 100 + k, ds, f"text {k}") for i, (ds, n) in enumerate(per_ds) for k in range(n)]
    return spark.createDataFrame(rows, "sample_id long, dataset string, reference string")


def _counts(df):
    return {r.dataset: r.n for r in df.groupBy("dataset").agg(F.count("*").alias("n")).collect()}


def test_quota_split_even(spark):
    q = even_quota(_samples(spark, [("ds1", 10), ("ds2", 10)]), 6)
    assert _counts(q) == {"ds1": 3, "ds2": 3}


def test_quota_remainder_goes_first_and_short_not_topped_up(spark):
    q = even_quota(_samples(spark, [("a", 10), ("b", 10), ("c", 1)]), 8)
    assert _counts(q) == {"a": 3, "b": 3, "c": 1}


def test_quota_zero_and_compat(spark):
    s = _samples(spark, [("a", 5), ("b", 5), ("c", 5)])
    assert _counts(even_quota(s, 2)) == {"a": 1, "b": 1}
    assert _counts(even_quota(s, 2, compat_min_one=True)) == {"a": 1, "b": 1, "c": 1}


def test_quota_first_rows_in_order(spark):
    q = even_quota(_samples(spark, [("a", 10)]), 3)
    assert sorted(r.sample_id for r in q.collect()) == [0, 1, 2]


def test_large_quota_uses_range_ranks(spark):
    q = even_quota(_samples(spark, [("a", 30), ("b", 5)]), 20001)
    assert _counts(q) == {"a": 30, "b": 5}


def test_quota_divides_by_registered_datasets(spark):
    every = _samples(spark, [("a", 10), ("b", 10), ("gone", 3)])
    q = even_quota(every.where("dataset <> 'gone'"), 9, registry=registry_of(every))
    assert _counts(q) == {"a": 3, "b": 3}
    assert dict(q.dtypes)["rn"] == "bigint" and dict(even_quota(every, 50_000).dtypes)["rn"] == "bigint"


def test_named_dataset(spark):
    every = _samples(spark, [("a", 3), ("b", 2)])
    assert named_dataset(every, "b", registry_of(every)).count() == 2
    assert named_dataset(every.where("dataset = 'a'"), "b", registry_of(every)).count() == 0
    with pytest.raises(Exception, match="Unknown dataset 'zz'. Available: a, b"):
        named_dataset(every, "zz", registry_of(every)).collect()


def _rows(sf, table):
    return duckdb.sql(f"SELECT count(*) FROM '{sf}/{table}.parquet'").fetchall()[0][0]


def test_loader_follows_the_registry(spark):
    sf = "/root/testdata/sf0.001"
    names = registry(spark, sf)
    every = _counts(load_datasets(spark, sf))
    assert set(every) <= set(names) and {"benchmark", "pages", "conversations", "documents-en-test"} <= set(every)
    assert _counts(load_datasets(spark, sf, "all")) == every
    for one in ("benchmark", "documents-en-test", "documents-de-train"):
        assert _counts(load_datasets(spark, sf, one)) == {one: every[one]}
    assert set(_counts(load_datasets(spark, sf, adhoc=ADHOC))) == {"custom"}
    with pytest.raises(KeyError, match="Available"):
        load_datasets(spark, sf, "zz")
    with pytest.raises(ValueError, match="mutually exclusive"):
        load_datasets(spark, sf, "benchmark", ADHOC)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_row_is_in_one_entry(spark, sf):
    found = {r.dataset: r.rows for r in src_registry(spark, sf).collect()}
    assert sum(n for d, n in found.items() if d.startswith("documents-")) == _rows(sf, "documents")
    assert all(found[t] == _rows(sf, t) for t in ("benchmark", "conversations", "pages"))
    # the same rows by one scan for each entry
    assert {n: scan_entry(spark, sf, e, n).count() for n, e in registry(spark, sf).items()} == found


def test_rows_without_a_language(spark, tmp_path):
    rows = [(1, "a", "en"), (-20, "b", None), (3, "c", None), (4, "d", "none"), (50, None, "xx-yy"), (20, "e", "en"), (None, "f", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, columns in (("benchmark", "item_id long, text string"), ("conversations", "turn long, text string"), ("pages", "page_id long, html string")):
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    want = {"documents-en-test": 1, "documents-en-train": 2, "documents-none-test": 1, "documents-none-train": 2, "documents-xx-yy-test": 1, "documents-xx-yy-train": 0}
    assert {r.dataset: r.rows for r in src_registry(spark, sf).collect() if r.path == "documents"} == want
    assert {n: scan_entry(spark, sf, e, n).count() for n, e in registry(spark, sf).items() if e.path == "documents"} == want
    assert _counts(load_datasets(spark, sf)) == {k: n for k, n in want.items() if n}


def test_unscorable_filters(spark):
    df = spark.createDataFrame([(1, "  ignore_time_segment_in_scoring "), (2, "word [inaudible] word"),
                                (3, "keep me"), (4, None), (5, "INAUDIBLE")], "sample_id int, reference string")
    assert sorted(r.sample_id for r in scorable(df).collect()) == [3, 4]


def test_resolve_selection():
    names = ["a", "b"]
    assert resolve_selection(names, None) == names
    assert resolve_selection(names, "all") == names
    assert resolve_selection(names, "b") == ["b"]
    with pytest.raises(KeyError, match="Available"):
        resolve_selection(names, "zz")
