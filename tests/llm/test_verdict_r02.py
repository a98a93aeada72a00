"""Cases that gave wrong results, lost rows or failed: long words that collide
in polynomial hashes, empty vectors, long headers and foreign digests, ids that
several texts share, columns with the names of results."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scribeval.llm import jaccard_join, keep, lattice_dedup, packing, queries, substring_dedup, tokens, topk_search, url_filter, warc, words

from . import brute

PATH = public_tokenizers.path(queries.TOKENIZER)


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


A = thue_morse(1024)
B = A.translate(str.maketrans("ab", "ba"))


# -- words of 1,024 letters that collide in every polynomial modulo 2**64 ---------------

def test_long_words_have_hashes_of_their_own():
    buf, offsets = words.text_buffer(pa.array([A, B, A + B, B + A]))
    starts, ends, _ = words.word_spans(buf, offsets)
    assert len(set(words.word_hashes(buf, starts, ends).tolist())) == 4


@pytest.mark.parametrize("n", [255, 256, 257, 300])
def test_hashes_do_not_depend_on_slices(monkeypatch, n):
    buf, offsets = words.text_buffer(pa.array(["x " + "y" * n + " z " + "y" * n, "é " * 50]))
    spans = words.word_spans(buf, offsets)
    whole = words.word_hashes(buf, *spans[:2], prefixes=(4, 6))
    monkeypatch.setattr(words, "SLICE_BYTES", 400)
    again = words.word_hashes(buf, *spans[:2], prefixes=(4, 6))
    assert all((a == b).all() for a, b in zip(whole, again)) and whole[0][1] == whole[0][3]


def test_ids_of_long_words():
    library = Tokenizer.from_file(PATH)
    texts = [A, B, f"x {A} y", f"x {B} y"]
    got = [x for _, part in tokens.Encoder(PATH).encode(pa.array(texts)) for x in part]
    assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert got[0] != got[1]


def test_windows_that_differ_in_a_long_word_stay(spark):
    shared = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{shared} {A}"), (2, f"{shared} {B}"), (3, f"{shared} {A}")], "doc_id long, text string")
    out = substring_dedup.remove_repeats(docs, window=20).collect()
    assert {r.doc_id: r.n_removed for r in out} == {1: 0, 2: 0, 3: 20}


def test_one_word_texts_do_not_link(spark):
    docs = spark.createDataFrame([(1, A), (2, B), (3, A)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.link(docs).collect()} == {1: 1, 2: 2, 3: 1}


# -- 2: empty vectors -----------------------------------------------------------------

def test_empty_vectors_take_no_part(spark):
    df = spark.createDataFrame([(0, []), (1, []), (2, [1.0, 2.0]), (50, [1.0, 1.0]), (100, [])], "vec_id long, embedding array<double>")
    rows = topk_search.search(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(50, 1, 2)]


# -- 4: the written order without a shuffle ---------------------------------------------

def test_packing_has_no_shuffle_and_no_sort(spark, tmp_path):
    spark.range(50).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(4).write.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    rows = out.collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and sorted(r.doc_id for r in rows) == list(range(50))


def test_files_without_an_order_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for name in ("x", "y"):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    with pytest.raises(ValueError, match="no order"):
        packing.written_places(spark.read.parquet(f"{tmp_path}/x", f"{tmp_path}/y"))
    with pytest.raises(ValueError, match="no sequence number"):
        packing.sequence_base(0, 1 << 40)


# -- 8: foreign archives ------------------------------------------------------------

def _record(payload, digest, http_header=""):
    http = f"HTTP/1.1 200 OK\r\n{http_header}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Payload-Digest: {digest}\r\n"
            f"Content-Length: {len(http)}\r\n\r\n").encode()
    return head + http + b"\r\n\r\n"


@pytest.mark.parametrize("payload", [True, False])
@pytest.mark.parametrize("header_bytes", [0, 1900, 5000, 70_000])
def test_long_http_headers(spark, tmp_path, header_bytes, payload):
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    (tmp_path / "a.warc").write_bytes(2 * _record(b"hello", f"sha1:{sha1}", "X-Long: " + "v" * header_bytes + "\r\n"))
    rows = warc.read(spark, tmp_path.as_uri(), payload=payload).collect()
    assert [(r.payload_bytes, r.payload_digest) for r in rows] == [(5, sha1)] * 2
    assert [r.payload and bytes(r.payload) for r in rows] == [b"hello" if payload else None] * 2


def test_digests_of_other_algorithms(spark, tmp_path):
    data = b"some payload"
    good = [f"sha256:{hashlib.sha256(data).hexdigest()}", f"sha-256:{base64.b32encode(hashlib.sha256(data).digest()).decode()}",
            f"md5:{hashlib.md5(data).hexdigest()}", f"SHA1:{base64.b32encode(hashlib.sha1(data).digest()).decode().lower()}", "odd:xyz"]
    (tmp_path / "a.warc").write_bytes(b"".join(_record(data, d) for d in good))
    assert [bytes(r.payload) for r in warc.read(spark, tmp_path.as_uri()).collect()] == [data] * 5
    (tmp_path / "a.warc").write_bytes(_record(data, f"sha256:{hashlib.sha256(b'other').hexdigest()}"))
    with pytest.raises(Exception, match="the digest of"):
        warc.read(spark, tmp_path.as_uri()).collect()


# -- ids that several texts share; clashing columns --------------------------------------

TEXT = [" ".join(f"{p}{i}" for i in range(40)) for p in ("red", "blue", "green")]


def test_rows_that_share_an_id_but_not_the_text_stay(spark):
    rows = [(5, TEXT[0], "a"), (5, TEXT[1], "b"), (5, TEXT[1], "c"), (3, TEXT[0], "d"), (9, TEXT[1] + " more", "e"), (None, TEXT[2], "f"),
            (None, TEXT[2], "g"), (7, TEXT[2], "h"), (8, None, "i"), (8, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    # one row of each text (group of near copies) is left, rows without an id stay
    assert sum(t in (TEXT[0],) for _, t in kept) == 1
    assert sum(t in (TEXT[1], TEXT[1] + " more") for _, t in kept) == 1
    assert sum(i is None for i, _ in kept) == 2 and (7, TEXT[2]) in kept
    assert sum(not t for _, t in kept) == 2


def test_names_are_ids_where_no_text_differs(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    assert sorted(map(str, (r[0] for r in docs.select(keep.named(docs)).collect()))) == ["1", "1", "2", "None"]


def test_cut_repeats_keeps_columns_with_the_names_of_results(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, passage + " one", "keep", 1.5, "s", 7), (2, "two " + passage, "this", 2.5, "t", 8)],
                                 "doc_id long, text string, n_words string, n_removed double, `a.b` string, n_chars int")
    out = corpus_pipeline.cut_repeats(spark, docs, "")
    assert out.dtypes == docs.dtypes
    rows = {r.doc_id: r for r in out.collect()}
    assert (rows[1].n_words, rows[1].n_removed, rows[1]["a.b"], rows[1].text, rows[1].n_chars) == ("keep", 1.5, "s", passage + " one", 7)
    assert (rows[2].n_words, rows[2].n_removed, rows[2]["a.b"], rows[2].text, rows[2].n_chars) == ("this", 2.5, "t", "two", 3)


def test_long_words_against_brute_force(spark):
    r = np.random.default_rng(0)
    pool = [A, B, "short", "tiny", "x" * 300, "x" * 299 + "y"]
    rows = [(i, " ".join(pool[k] for k in r.integers(0, 6, int(r.integers(1, 60))))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.cut_repeats(rows, 20)
    for row in substring_dedup.remove_repeats(docs, window=20).collect():
        assert (row.n_words, row.n_removed, row.kept_text) == (want[row.doc_id][0], want[row.doc_id][1], " ".join(want[row.doc_id][2]))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(docs).collect()}
    assert got == brute.jaccard_components(rows, 4, 85)


# -- 7: recall at any number of dimensions --------------------------------------------

@pytest.mark.parametrize("dim", [2, 8, 16, 24, 32, 64, 300])
def test_lattice_recall_follows_the_dimension(dim):
    r = np.random.default_rng(dim)
    a, o = r.standard_normal((2, 1500, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951 ** 2) * o
    named = [lattice_dedup.cells(x, 8, 2, lattice_dedup.fitting_scale(dim, 2, 0.95)).reshape(-1, 8, 4) for x in (a, b)]
    met = np.zeros(len(a), bool)
    for x, y in (named, named[::-1]):
        met |= (x == y[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.98


@pytest.mark.parametrize("dim", [8, 16, 24])
def test_lattice_finds_links_of_short_vectors(spark, dim):
    r = np.random.default_rng(dim)
    base = r.standard_normal((60, dim))
    rows = [(i, (base[i % 60] + 0.12 * r.standard_normal(dim)).tolist()) for i in range(240)]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sum(row.n_links for row in lattice_dedup.dedup(df).collect())
    assert 0.97 * want.sum() <= got <= want.sum() and want.sum() > 300


# -- 3: many rules are one expression -------------------------------------------------

def test_plan_does_not_grow_with_the_rules(spark):
    def rules(n):
        return spark.createDataFrame([(f"h{i}.site{i % 7}.org", "/" + "p" * (i % 200), "block") for i in range(n)] + [("org", "/x/", "allow")],
                                     "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://h3.site3.org/ppp/q"), (2, "http://a.h3.site3.org/pp"), (3, "http://org/x/y"), (4, "http://site3.org/ppp"), (5, None)],
                                  "page_id long, url string")
    few, many = (url_filter.judge(pages, rules(n)) for n in (10, 2000))
    assert len(many._jdf.queryExecution().analyzed().toString()) < 1.2 * len(few._jdf.queryExecution().analyzed().toString()) + 8000
    got = {r.page_id: (r.rule, r.verdict) for r in few.collect()}
    assert got == {1: ("h3.site3.org/ppp", "block"), 2: (None, "allow"), 3: ("org/x/", "allow"), 4: (None, "allow"), 5: (None, "allow")}
    assert {r.page_id: r.rule for r in many.collect()} == {k: v[0] for k, v in got.items()}
