"""Places where less than the whole job was done."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scribeval.llm import lattice_dedup, packing, queries, tokens, toxicity
from scribeval.sources.tables import table_path

SF = "/root/testdata/sf0.001"


# -- 10 toxicity: the cut --------------------------------------------------------

def test_cut_is_finite_with_a_clean_row_on_top():
    # one clean row above eight toxic ones: no cut has a precision of 0.9
    severity = np.concatenate([[1.99], np.linspace(1.9, 1.2, 8), np.linspace(0.5, 0.0, 100)])
    positive = np.zeros(len(severity), bool)
    positive[1:9] = True
    cut = toxicity._best_cut(severity, positive, 0.9)
    assert (severity >= cut).sum() == 9 and (positive & (severity >= cut)).sum() == 8


@pytest.mark.parametrize("noise", [0.0, 0.15, 0.3])
def test_cut_finds_toxic_rows_with_noisy_labels(noise):
    r = np.random.default_rng(3)
    toxic = np.arange(2000) < 200
    severity = np.where(toxic, 1.5, 0.2) + r.normal(0, 0.05, 2000)
    labelled = toxic & (r.random(2000) >= noise)
    said = severity >= toxicity._best_cut(severity, labelled, 0.9)
    assert said[toxic].mean() > 0.95 and not said[~toxic].any()


def test_folds_leave_rows_of_both_classes():
    for n in (2, 3, 7):
        positive = np.arange(50) < n
        fold = toxicity._folds(positive)
        assert fold.min() == 0
        assert all((positive & (fold != k)).any() and (~positive & (fold != k)).any() for k in range(fold.max() + 1))
    assert (toxicity._folds(np.arange(50) < 1) == -1).all()


def test_pipeline_drops_toxic_documents(spark):
    docs = spark.read.parquet(table_path(SF, "documents"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{table_path(SF, 'labels')}'").fetchall())
    toxic = {r.doc_id for r in docs.select("doc_id").collect() if labels.get(r.doc_id) == 1}
    assert len(toxic - kept) >= len(toxic) / 2


# -- 1, 4 token ids: added tokens --------------------------------------------------

ADDED = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b, c.", "plain words", None, "",
         "x <|endoftext|>", "<|endoftext|> <|endoftext|>\ny", "<|endof", "text|> after", "hello world, again."]


def test_ids_are_those_of_the_library_as_it_loads():
    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in ADDED]
    enc = tokens.encoder(path)
    for size in (1 << 20, 20):
        assert [x for _, part in enc.encode(pa.array(ADDED), max_bytes=size) for x in part] == want
    assert np.frombuffer(want[0], "<u4").tolist() == [31373, 220, 50256, 995]


def test_packing_keeps_added_tokens(spark):
    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.pack(docs, path).collect()}
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in ADDED]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)}


# -- pipeline: the training order reaches the sequences ------------------------------

def test_packing_keeps_the_written_order_of_several_files(spark, tmp_path):
    # later part files are larger, and are read first
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(
        F.lit(0).cast("long"), F.col("id") % 50 + F.floor(F.col("id") / 4)), lambda k: F.concat(F.lit("w"), F.xxhash64("id", k).cast("string")))).alias("text"))
    docs.withColumn("at", F.xxhash64("doc_id") % 5 + F.col("doc_id")).repartitionByRange(12, "at").sortWithinPartitions(
        "at", "doc_id").drop("at").write.parquet(f"{tmp_path}/mixed")
    assert len(list((tmp_path / "mixed").glob("part-*"))) == 12
    written = [i for f in sorted((tmp_path / "mixed").glob("part-*")) for (i,) in duckdb.sql(
        f"SELECT doc_id FROM read_parquet('{f}', file_row_number = true) ORDER BY file_row_number").fetchall()]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert got == written


def test_packing_takes_rows_of_no_file(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in corpus_pipeline.pack_sequences(spark, docs, SF).collect()] == [1, 2]


# -- 7 lattice: null and negative ids ------------------------------------------------

def _near(n, seed, spread=0.01):
    """Unit vectors in a tight group of their own."""
    r = np.random.default_rng(seed)
    x = r.standard_normal(64)
    x = x / np.linalg.norm(x) + spread * r.standard_normal((n, 64)) / 8
    return x.tolist()


def _found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_dedup.dedup(df).collect()),
                  key=lambda t: (t[0] is None, t[0] or 0))


def test_lattice_null_ids_keep_their_neighbours_together(spark):
    one, other, alone = _near(5, 1), _near(4, 2), _near(2, 3)
    rows = [(7, one[0]), (5, one[1]), (9, one[2]), (None, one[3]), (None, one[4]), (20, other[0]), (21, other[1]),
            (None, other[2]), (1 << 62, other[3]), (None, alone[0]), (None, alone[1])]
    got = _found(spark, rows)
    assert got[:6] == [(5, 4, 5, True), (7, 4, 5, False), (9, 4, 5, False), (20, 3, 20, True), (21, 3, 20, False),
                       (1 << 62, 3, 20, False)]
    assert sorted(got[6:], key=repr) == sorted([(None, n, None, None) for n in (4, 4, 3, 1, 1)], key=repr)


def test_lattice_null_id_joins_what_links_only_through_it(spark):
    # the ends are at cosine 0.92 of each other, the middle at 0.98 of both
    at = [np.eye(64)[0] * np.cos(a) + np.eye(64)[1] * np.sin(a) for a in (-0.2, 0.0, 0.2)]
    got = _found(spark, [(3, at[0].tolist()), (None, at[1].tolist()), (8, at[2].tolist())])
    assert got == [(3, 1, 3, True), (8, 1, 3, False), (None, 2, None, None)]


def test_lattice_negative_ids(spark):
    one, other = _near(4, 4), _near(3, 5)
    got = _found(spark, [(-1, one[0]), (-9, one[1]), (4, one[2]), (None, one[3]), (-2, other[0]), (6, other[1]), (8, other[2])])
    assert got == [(-9, 3, -9, True), (-2, 2, -2, True), (-1, 3, -9, False), (4, 3, -9, False), (6, 2, -2, False),
                   (8, 2, -2, False), (None, 3, None, None)]


def test_lattice_says_when_no_number_is_left(spark):
    one = _near(2, 6)
    with pytest.raises(ValueError, match="null id"):
        _found(spark, [((1 << 63) - 1, one[0]), (None, one[1])])
