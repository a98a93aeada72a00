import random

import pytest
from pyspark.sql import functions as F

from scribeval.operators import rangejoin, search, textlines


def _write(tmp_path, name, parts):
    folder = tmp_path / f"text={name}"
    folder.mkdir()
    for i, p in enumerate(parts):
        (folder / f"part-{i:05d}.txt").write_bytes(p)


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _got(spark, path):
    out = {}
    for r in textlines.read_lines(spark, str(path)).orderBy("text", "line_no").collect():
        out.setdefault(r.text, []).append((r.line_no, r.line))
    return out


def test_one_large_text_is_numbered_in_many_tasks(spark, tmp_path, small_splits):
    r = random.Random(1)
    lines = ["x" * r.randint(0, 200) + str(i) for i in range(20_000)]
    _write(tmp_path, "big", ["\n".join(lines).encode()])
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    assert _got(spark, tmp_path) == {"big": list(enumerate(lines))}


def test_parts_breaks_and_empty_texts(spark, tmp_path, small_splits):
    _write(tmp_path, "a", [b"one\r\ntwo\n", b"", b"three\rstill three\n\n", b"last"])
    _write(tmp_path, "b", [b"\n"])
    _write(tmp_path, "c", [b""])
    _write(tmp_path, "d e", ["ü\nlong ".encode() + b"y" * 100_000 + b"\nend\n"])
    assert _got(spark, tmp_path) == {
        "a": [(0, "one"), (1, "two"), (2, "three\rstill three"), (3, ""), (4, "last")], "b": [(0, "")],
        "d e": [(0, "ü"), (1, "long " + "y" * 100_000), (2, "end")]}


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_range_join_equals_all_pairs(spark, width):
    r = random.Random(2)
    points = [(r.choice(["a", "b", None]), r.choice([r.randint(-50, 300), None])) for _ in range(400)] + [("a", 5)] * 50
    ranges = [(r.choice(["a", "b", "c", None]), i, s, s + r.choice([0, -3, 1, 4, 60])) for i in range(60) for s in [r.randint(-60, 250)]]
    ranges.append(("a", 99, -1000, 100_000))
    p = spark.createDataFrame(points, "k string, at int").repartition(3)
    q = spark.createDataFrame(ranges, "k string, id int, lo int, hi int")
    got = sorted((x.k, x["at"], x.id) for x in rangejoin.range_join(p, q, ["k"], "at", "lo", "hi", width).collect())
    assert got == sorted((k, at, i) for k, at in points for kk, i, lo, hi in ranges if k is not None and k == kk and at is not None and lo <= at < hi)
    plan = rangejoin.range_join(p, q, ["k"], "at", "lo", "hi", 7)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_on_rows_equals_the_array_form(spark):
    r = random.Random(3)
    bodies = [(i, "\n".join(" ".join(r.choice(["alpha", "beta", "gamma", "x", "y"]) for _ in range(3)) for _ in range(r.randint(1, 400)))) for i in range(12)]
    texts = spark.createDataFrame(bodies, "text long, body string")
    found = search.search_texts(texts, "alpha Beta", limit=5, key="text")
    lines = texts.select("text", F.posexplode(search.split_lines(F.col("body"))).alias("line_no", "line"))
    windows = textlines.search_lines(lines, "alpha Beta", limit=5)
    cols = ["text", "window_no", "hit_line", "start", "end"]
    assert sorted(map(tuple, windows.select(cols).collect())) == sorted(map(tuple, search.windows_of(found, "text").select(cols).collect()))
    want = sorted(map(tuple, search.window_lines(found, "text").collect()))
    assert sorted(map(tuple, textlines.window_lines(lines, windows).collect())) == want
    assert {x.text: x.n_hits for x in windows.collect()} == {x.text: x.total_hits for x in found.collect() if x.total_hits}


def test_text_files_have_as_many_parts_as_the_texts_fill(spark, tmp_path, monkeypatch):
    from scribeval.plans import tools
    rows = [(i, "line " * 20 + f"{i}\nsecond", f"src{i % 2}" if i % 7 else None) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    few = sorted(map(tuple, tools.src_text_files(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tools, "TEXT_PART", 2000)
    path = tools.text_files(spark, str(tmp_path))
    # before: four tasks, whatever the size
    assert len(spark.read.text(path).inputFiles()) > 15
    assert sorted(map(tuple, tools.src_text_files(spark, str(tmp_path)).collect())) == few and len(few) == 800
