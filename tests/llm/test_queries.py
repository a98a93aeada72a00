"""Registered queries against their SQL twins or brute force, on whole small tables."""

import math

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zlib
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from scribeval.llm import lattice_dedup, queries, toxicity
from scribeval.sources.tables import TABLES, table_path

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


@pytest.fixture(scope="module")
def ids_of(con):
    tok = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    rows = con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    return {i: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in rows}


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def test_all_are_registered():
    names = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    rel = con.sql(queries.ORACLE[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())


def test_token_files_hold_every_text(spark, ids_of):
    rows = E.queries()["op1_token_files"](spark, SF).collect()
    at, want = 0, {}
    for i in sorted(ids_of):
        want[i] = (at, len(ids_of[i]), zlib.crc32(ids_of[i].tobytes()))
        at += len(ids_of[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def test_packing_covers_every_text_with_little_padding(spark, ids_of):
    rows = [r.asDict() for r in E.queries()["op4_packing"](spark, SF).collect()]
    assert brute.check_pieces(rows, ids_of) < 0.03


def test_lattice_recall_is_measured_against_brute_force(spark):
    # the table's vectors with copies just within the threshold and closer by
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{table_path('/root/testdata/sf0.01', 'embeddings')}'").fetchall()
    x = np.array([e for _, e in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = np.random.default_rng(8)
    every = [x]
    for cosine in (0.951, 0.96, 0.975, 0.99):
        off = r.standard_normal(x.shape)
        off -= (off * x).sum(axis=1, keepdims=True) * x
        every.append(cosine * x + np.sqrt(1 - cosine ** 2) * off / np.linalg.norm(off, axis=1, keepdims=True))
    x = np.concatenate(every)
    dot = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    np.fill_diagonal(dot, 0)
    want = (dot >= 0.95).sum(axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in lattice_dedup.dedup(df).collect()}
    assert want.sum() > 3000 and sum(got.values()) >= 0.98 * want.sum()
    assert all(got[i] <= n for i, n in enumerate(want))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    model = toxicity.fit(spark.read.parquet(table_path(sf, "documents")), spark.read.parquet(table_path(sf, "labels")))
    f = model.cross_validated
    assert f["rows"] > 50 and f["hits"] / max(1, f["said"]) >= 0.9 and f["hits"] / f["toxic"] >= 0.6
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    rows = E.queries()["op10_toxicity"](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.severity <= 2 for r in rows)
    assert all(r.toxic == (r.severity >= model.cut) for r in rows)


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(table_path(SF, "documents"))
    frames = [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(docs.toPandas())
    columns = list(frames[0].columns)
    assert all(list(f.columns) == columns for f in frames[:-1])
    raw, clean, single, cut, mixed, packed = frames
    # toxicity: what stays is as it was; few labelled clean documents go
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{table_path(SF, 'labels')}'").fetchall())
    gone = set(raw.doc_id) - set(clean.doc_id)
    assert sum(labels.get(i) == 0 for i in gone) <= 1
    texts = dict(zip(raw.doc_id, raw.text))
    assert all(texts[i] == t for i, t in zip(clean.doc_id, clean.text))
    # near copies: exactly the smallest id of every component
    want = brute.jaccard_components(list(zip(clean.doc_id, clean.text)), 5, 80)
    assert sorted(single.doc_id) == sorted(i for i, (_, c) in want.items() if c == i)
    # repeated windows
    want = brute.cut_repeats(list(zip(single.doc_id, single.text)), 20)
    assert sorted(cut.doc_id) == sorted(single.doc_id)
    for i, t, n in zip(cut.doc_id, cut.text, cut.n_chars):
        assert brute.words(t) == want[i][2] and (want[i][1] == 0 or n == len(t))
    # mix: sources near their targets
    size, source = {}, {}
    for i, t, s in zip(cut.doc_id, cut.text, cut.source):
        size[i], source[i] = len(brute.words(t)), s
    total = {s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())}
    goal = brute.targets(total)
    took = {s: sum(len(brute.words(t)) for t, x in zip(mixed.text, mixed.source) if x == s) for s in total}
    longest = {s: max(n for i, n in size.items() if source[i] == s) for s in total}
    assert all(abs(took[s] - goal[s]) <= 1 + longest[s] / 2 for s in total)  # no text is cut
    assert set(zip(mixed.doc_id, mixed.text)) <= set(zip(cut.doc_id, cut.text))
    # packing: every copy of a document whole
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    n = sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in mixed.text)
    assert packed.length.sum() == n
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()
