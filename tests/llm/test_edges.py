"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names, against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scribeval.llm import (bloom, graph, jaccard_join, keep, lattice_dedup, mixing, packing, queries, substring_dedup,
                           token_files, tokens, topk_search, toxicity, url_filter, warc, words)

from . import brute

PATH = public_tokenizers.path(queries.TOKENIZER)
LONG = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
BASE = [f"alpha{i}" for i in range(80)]


def _edit(n):
    w = list(BASE)
    w[n % 80] = f"other{n}"
    return " ".join(w)


TEXTS = [
    (1, None), (2, ""), (3, "one"), (4, "one two three"), (5, "One TWO three"), (6, " \t\n\x0b "),
    (7, LONG), (8, LONG), (9, LONG + " tail"), (10, " ".join(BASE)), (11, " ".join(BASE)), (12, _edit(1)), (13, _edit(40)),
    (14, f"start {PASSAGE} end"), (15, f"begin\n{PASSAGE}\nstop"), (16, PASSAGE + " " + PASSAGE), (17, "word " * 70),
    (18, "naïve\u00a0café  ünïcode\u3000x y. z, it's we'll 12 a1,b2 ... !!"), (19, "x" * 5000), (20, "same words here now"),
    (21, "same words here now extra"), (-5, "\x01 odd \x1c marks\x85here"),
]
#: Columns that clash with names the operators use or return.
CLASH = {"n_words": "1", "severity": "2", "grade": "3", "toxic": "'t'", "component_id": "4", "size": "5", "target": "6",
         "taken": "7", "tokens": "8", "block": "9", "id": "10", "key": "11", "kept_text": "'k'", "_id": "12", "_row": "13",
         "h": "14", "comp": "15", "n": "16", "text2": "17", "rank": "18", "start": "19"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", len(t or "")) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", *[f"{v} AS `{c}`" for c, v in CLASH.items()]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_word_hashes_follow_words():
    texts = [t for _, t in TEXTS]
    buf, offsets = words.text_buffer(pa.array(texts))
    starts, ends, first = words.word_spans(buf, offsets)
    got = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert got == [w for t in texts for w in brute.words(t)]
    assert np.diff(first).tolist() == [len(brute.words(t)) for t in texts]
    h = words.word_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(set(got))
    w, at = words.window_hashes(h, first, 20)
    keys = {}
    flat = [brute.words(t) for t in texts]
    want = [(d, s) for d, x in enumerate(flat) for s in range(len(x) - 19)]
    assert len(w) == len(want)
    for value, (d, s) in zip(w.tolist(), want):
        assert keys.setdefault(value, tuple(flat[d][s:s + 20])) == tuple(flat[d][s:s + 20])
    assert len(keys) == len({tuple(flat[d][s:s + 20]) for d, s in want})


def test_word_slices_do_not_change_hashes(monkeypatch):
    buf, offsets = words.text_buffer(pa.array([t for _, t in TEXTS]))
    spans = words.word_spans(buf, offsets)
    whole = words.word_hashes(buf, *spans[:2])
    windows = words.window_hashes(whole, spans[2], 20)[0]
    monkeypatch.setattr(words, "SLICE_BYTES", 6000)
    assert (words.word_hashes(buf, *spans[:2]) == whole).all()
    assert (words.window_hashes(whole, spans[2], 20)[0] == windows).all()


def test_encoder_equals_library(tokenizer):
    texts = [t for _, t in TEXTS] + ["a b  c\td", "  lead", "trail ", "a\nb c, d.", "a\n\nb", "a\x0bb", "<|endoftext|> x", "日本 語。"]
    enc = tokens.Encoder(PATH)
    for _ in range(2):
        got = [x for _, part in enc.encode(pa.array(texts), max_bytes=1000) for x in part]
        assert got == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    small = tokens.Encoder(PATH, max_words=10)
    assert [x for _, part in small.encode(pa.array(texts)) for x in part] == got


# -- 1 token files -----------------------------------------------------------

def _ids(tokenizer):
    return {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in TEXTS}


def test_token_files(spark, docs, empty, tokenizer, tmp_path):
    more = docs.unionByName(docs.where("doc_id = 4")).unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    token_files.write(more, f"{tmp_path}/a", PATH)
    ids = _ids(tokenizer)
    order = [(None, 3), *((i, i) for i in sorted([*ids, 4]))]
    at, want = 0, []
    for name, i in order:
        want.append((name, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    plain = token_files.read(spark, f"{tmp_path}/a")
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(want, key=key)
    mixed = token_files.read(spark, f"{tmp_path}/a", shuffle_seed="7", with_ids="true").collect()
    assert sorted((tuple(r)[:4] for r in mixed), key=key) == sorted(want, key=key)
    assert all(np.array_equal(np.frombuffer(bytes(r.ids), "<u4"), ids[r.doc_id]) for r in mixed if r.doc_id is not None)
    token_files.write(empty, f"{tmp_path}/b", PATH)
    assert token_files.read(spark, f"{tmp_path}/b").count() == 0


def test_token_files_notice_damage(spark, docs, tmp_path):
    token_files.write(docs.where("doc_id IN (3, 4)").coalesce(1), f"{tmp_path}/a", PATH)
    file = max(tmp_path.glob("a/*.tok"), key=lambda p: p.stat().st_size)
    raw = bytearray(file.read_bytes())
    raw[-6] ^= 1
    file.write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        token_files.read(spark, f"{tmp_path}/a").collect()


# -- 2 top-k -----------------------------------------------------------------

def _vectors():
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.standard_normal(24)]) for i in range(120)]
    rows += [(200, [0.0] * 24), (250, None), (300, [1.0] * 24), (301, [1.0] * 24), (302, [1.0] * 24), (350, [float("nan")] * 24),
             (400, [None] + [1.0] * 23), (401, [float("inf")] * 24), (450, [0.5, 0.25]), (451, [0.5, 0.25]), (452, []), (453, [-0.0] * 24)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(_vectors(), "vec_id long, embedding array<double>")
    return df.selectExpr("*", *[f"{v} AS `{c}`" for c, v in CLASH.items()]).repartition(3)


def test_top_k(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES_A_BLOCK", 40)
    out = topk_search.search(vectors, F.col("vec_id") % 50 == 0, k=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in brute.top_k(_vectors(), 5).items() if v}
    assert got == want
    assert topk_search.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(0, [2.0 ** 40, 1.0]), (1, [2.0 ** 10, 3.0]), (2, [2.0 ** 10, 2.0]), (3, [-2.0 ** 40, 1.0]), (4, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk_search.search(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    # 256 * 2**40 times 256 * 2**10 is 2**66: the three scores are held at the top, ties by id
    assert got == [(1, 2 ** 63 - 1), (2, 2 ** 63 - 1), (4, 2 ** 63 - 1)]
    low = [(r.vec_id, r.score) for r in topk_search.search(df, F.col("vec_id") == 1, k=5).orderBy("rank").collect()]
    assert low == [(0, 2 ** 63 - 1), (4, 2 ** 63 - 1), (2, 2 ** 36 + 256 * 256 * 6), (3, -2 ** 63)]


# -- 3 URLs ------------------------------------------------------------------

def test_url_filter(spark):
    urls = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?q#f"), (4, "x://org"), (5, "x://org/"), (6, "x://com/fr/de"),
            (7, "x://a.com/de/"), (8, "x://notcom/de/"), (9, "x://example.org/en/12"), (10, "x://example.org/en/2"), (11, ""),
            (11, "x://com/de/1"), (11, "x://com/de/1"), (None, "x://com/de/1"), (12, "a://b://org/"), (13, "x:///de/"), (14, "x://.org/é")]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS key", "3 AS rule", "4 AS n")
    rules = spark.createDataFrame(queries.URL_RULES + [("com", "/de/", "allow")], "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge(pages, rules, salts=3).collect()), key=repr)
    want = []
    for i, u in urls:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = rest[:cut].translate(brute.LOWER)
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, best[1], best[2]))
    assert got == sorted(want, key=repr)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_bloom_never_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    w = bloom.build(keys, 5000)
    have = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    assert bloom.contains(w, have).all()
    other = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    assert bloom.contains(w, other).mean() < 0.02
    tiny = bloom.build(keys, 5000, max_bytes=bloom.BLOCK_BYTES * bloom.SLICES)
    assert bloom.contains(tiny, have).all()


# -- 4 packing ---------------------------------------------------------------

def test_packing(docs, empty, tokenizer):
    rows = [r.asDict() for r in packing.pack(docs, PATH, length=64, block_tokens=500).collect()]
    brute.check_pieces(rows, _ids(tokenizer), 64)
    twice = packing.pack(docs.where("doc_id = 4").unionByName(docs.where("doc_id = 4")), PATH).collect()
    assert sum(r.length for r in twice) == 2 * len(_ids(tokenizer)[4])
    assert packing.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    r = np.random.default_rng(seed)
    at = np.concatenate([[0], np.cumsum(r.integers(1, 9, 60))])
    penalty = r.choice([0.0, 2.0, 7.0], len(at))
    length = 16
    pad = lambda n: 0 if n & (n - 1) == 0 else length - n
    best = [0.0] + [np.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        best[j] = penalty[j] + min(best[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= length)
    cuts = packing.cut_points(at, penalty, length)
    got = sum(pad(int(b - a)) for a, b in zip(np.concatenate([[0], at[cuts[:-1]]]), at[cuts])) + penalty[cuts].sum()
    assert got == best[-1]


# -- 5 mixing ----------------------------------------------------------------

def test_mixing(docs, empty):
    more = docs.unionByName(docs.where("doc_id = 10"))
    rows = mixing.plan(more).collect()
    size, total = {}, {}
    for r in rows:
        assert r["size"] == len(brute.words(dict(TEXTS)[r._id]))
        total[r.source] = total.get(r.source, 0) + r["size"]
    goal = brute.targets(total)
    for s in total:
        mine = [r for r in rows if r.source == s]
        assert all(r.source_size == total[s] and abs(r.target - goal[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[s]) <= 1
        assert all(0 <= r.taken <= 2 * r["size"] for r in mine)
        assert all(0 <= p <= 1 for r in mine for p in r.positions)
    assert sorted(map(str, mixing.plan(more.repartition(5)).collect())) == sorted(map(str, rows))
    out = mixing.training_order(more)
    assert out.columns == more.columns
    # a copy of which at least half is wanted comes whole, others not at all
    want = [r._id for r in rows for _ in range(r.passes + (r.last > 0 and 2 * r.last >= r["size"])) if r["size"]]
    got = out.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, want))
    assert all(r.text == dict(TEXTS)[r.doc_id] for r in got if r.doc_id in dict(TEXTS))
    assert mixing.plan(empty).count() == 0 and mixing.training_order(empty).count() == 0


def test_demand_is_inverted(spark):
    for schedule in mixing.SCHEDULES:
        ys = [0.0, 0.1, 0.3, 0.5, 0.75, 1.0]
        df = spark.createDataFrame([(y,) for y in ys], "y double")
        for r in df.withColumn("t", mixing.inverse_demand(F.col("y"), schedule)).collect():
            grid = np.linspace(0, r.t, 20001)
            level = np.interp(grid, [t for t, _ in schedule], [m for _, m in schedule])
            assert abs(np.trapezoid(level, grid) - r.y) < 1e-6


# -- 6 substrings ------------------------------------------------------------

def test_substring_dedup(docs, empty):
    out = substring_dedup.remove_repeats(docs, window=20, block_bytes=1 << 14, range_bytes=1 << 15)
    want = brute.cut_repeats(TEXTS, 20)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, gone, " ".join(kept))
        assert sum(s.n_words for s in r.removed_spans) == gone and r.text == dict(TEXTS)[r.doc_id] and r.grade == 3
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_repeated_rows(docs):
    twice = docs.unionByName(docs.where("doc_id IN (10, 14)")).unionByName(
        docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    rows = substring_dedup.remove_repeats(twice, carry=[], keep_text=False).collect()
    assert len(rows) == len(TEXTS) + 3
    of = lambda i: [r.n_removed for r in rows if r.doc_id == i]
    assert of(None) == [0]  # a null id is the smallest
    assert of(10) == [80, 80] and of(14) == [0, 0] and of(11) == [80]


# -- 7 embeddings ------------------------------------------------------------

def test_lattice_dedup(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows, base = [], r.standard_normal((8, 32))
    for i in range(160):
        v = base[i % 8] + r.standard_normal(32) * (0.05 if i % 3 else 0.28)
        rows.append((i, [float(x) for x in v]))
    rows += [(200, None), (201, [0.0] * 32), (202, [None] * 32), (203, [float("nan")] * 32), (204, [1.0, 1.0]), (205, [2.0, 2.0]),
             (206, []), (207, [1e-200] * 32), (208, [1e200] * 32), (209, [1.0] * 32), (210, [1.0] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS rep", "3 AS h1", "4 AS links")
    big = lambda v: v if v is None or not v or None in v else [x / (max(map(abs, v)) or 1) for x in v]
    want = brute.cosine_links([(i, big(v)) for i, v in rows], 0.95)
    monkeypatch.setattr(lattice_dedup, "MEMBERS", 16)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in lattice_dedup.dedup(df).collect()}
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())
    assert got[200] == (0, 200, True) and got[203] == (0, 203, True) and got[205] == (1, 204, False)
    assert got[207][1] == 207 and got[208][0] == got[209][0] == 3
    assert lattice_dedup.dedup(df.limit(0)).count() == 0


def test_e8_points_are_nearest():
    x = np.random.default_rng(2).standard_normal((50, 8)) * 1.5
    point, second = lattice_dedup.decode(x)
    for p in (point, second):
        same = (p % 2 == p[:, :1] % 2).all(axis=1)
        assert same.all() and ((p.sum(axis=1) / 2) % 2 == 0).all()
    near = lambda p: ((x - p / 2) ** 2).sum(axis=1)
    assert (near(point) <= near(second) + 1e-12).all() and near(point).max() <= 1 + 1e-9  # covering radius 1


def test_components(spark):
    r = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    df = spark.createDataFrame(pairs + [(None, 3)], "u long, v long")
    got = {x.node: x.component_id for x in graph.components(df).collect()}
    nodes = sorted({n for p in pairs for n in p})
    want = brute.roots(nodes, pairs)
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert graph.components(df.limit(0)).count() == 0


# -- 8 WARC ------------------------------------------------------------------

def test_warc(spark, tmp_path):
    rows = [(5, "http://a/", "<p>x</p>"), (3, "http://b/", "<p>x</p>"), (4, None, None), (6, "http://c/\r\nX: 1", ""), (7, "u", "é" * 200_000),
            (None, "n", "<p>x</p>"), (8, "v", "\r\n\r\nbody"), (9, "r", "rep"), (9, "r", "rep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 AS payload", "2 AS sha1", "3 AS first", "4 AS refers_to", "5 AS n")
    warc.write(pages, f"{tmp_path}/a")
    got = warc.read(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(rows)
    firsts = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r.page_id)
        first = firsts[html]
        assert r.record_type == ("response" if r.page_id == first else "revisit")
        assert r.refers_to == (None if r.page_id == first else first)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == warc.digest(html.encode())
        assert r.payload == (bytearray(html.encode()) if r.record_type == "response" else None)
    warc.write(pages, f"{tmp_path}/b", least_bytes=5)
    assert sorted(r.record_type for r in warc.read(spark, f"{tmp_path}/b").collect()).count("revisit") == 2
    warc.write(pages.limit(0), f"{tmp_path}/c")
    assert warc.read(spark, f"{tmp_path}/c").count() == 0


def test_warc_predicates_are_pushed(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "same" if i % 2 else f"h{i}") for i in range(10)], "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/a")
    df = warc.read(spark, f"{tmp_path}/a").where("record_type = 'revisit' AND page_id IN (3, 4, 5)")
    assert sorted(r.page_id for r in df.collect()) == [3, 5]
    reader = warc.WarcReader(f"{tmp_path}/a", True)
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 4)]))
    assert len(rest) == 1 and reader.wanted == [("record_type", {"revisit"})]
    light = warc.read(spark, f"{tmp_path}/a", payload=False)
    assert {r.payload for r in light.collect()} == {None} and light.where("payload_bytes = 4").count() == 5


def test_warc_of_other_writers(spark, tmp_path):
    import gzip
    one = warc.record(1, "u", b"abc", __import__("hashlib").sha1(b"abc").digest(), None)
    two = warc.record(2, "v", b"abc", __import__("hashlib").sha1(b"abc").digest(), 1)
    (tmp_path / "x.warc").write_bytes(one + two)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = warc.read(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2
    assert gzip.decompress(warc.member(one)) == one


# -- 9 Jaccard ---------------------------------------------------------------

@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, empty, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link(docs, shingle=k, percent=percent, block_bytes=1 << 15).collect()}
    assert got == brute.jaccard_components(TEXTS, k, percent)
    assert jaccard_join.link(empty).count() == 0


def test_jaccard_join_against_brute_force(spark):
    r = np.random.default_rng(9)
    rows = []
    for b in range(12):
        base = [f"b{b}w{i}" for i in range(int(r.integers(5, 90)))]
        for _ in range(12):
            w = list(base)
            for p in r.integers(0, len(w), int(r.integers(0, 4))):
                w[p] = f"r{r.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(w) + (" " + PASSAGE if r.random() < 0.3 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.link(df, group_tokens=200, block_bytes=4000).collect()}
    assert got == brute.jaccard_components(rows, 4, 85)


def test_one_of_each(docs, empty):
    more = docs.unionByName(docs.where("doc_id IN (10, 3)")).unionByName(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    groups = jaccard_join.link(more, shingle=5, percent=80)
    rows = keep.one_of_each(more, groups)
    assert rows.columns == more.columns
    want = brute.jaccard_components(TEXTS, 5, 80)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows.collect()) == sorted(
        [(False, i) for i, (_, c) in want.items() if c == i] + [(True, 0)])
    assert keep.one_of_each(empty, jaccard_join.link(empty)).count() == 0


# -- 10 toxicity -------------------------------------------------------------

def _tainted(n, toxic):
    w = [f"n{(n * 31 + i * 7) % 400}" for i in range(30)]
    if toxic:
        w[5:5] = [f"Vilestem{n % 17}x,", "awful!", "Hatefully", "(grim)"][:2 + n // 4 % 3]
    return " ".join(w)


def test_toxicity(spark, docs, empty):
    rows = [(1000 + i, _tainted(i, i % 4 == 0), "en", "s", 1) for i in range(600)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int((i - 1000) % 4 == 0)) for i, *_ in rows[:400]] + [(None, 1), (1001, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(texts, labels, max_rows=350)
    judged = {r.doc_id: r for r in toxicity.score(texts, model).collect()}
    assert all(judged[i].toxic == ((i - 1000) % 4 == 0) for i in judged)
    assert {r.grade for r in judged.values()} >= {0, 2}
    out = toxicity.score(docs, model)
    assert set(out.columns) == set(docs.columns) and not any(r.toxic for r in out.collect())
    assert toxicity.accepted(docs, model).columns == docs.columns
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels)
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())
    assert not len(toxicity.fit(texts, labels.where("toxic = 0")).places)


def test_cumulative_link_learns_ordered_grades():
    r = np.random.default_rng(0)
    x = r.random((400, 5)) < 0.3
    grades = np.clip(x[:, 0].astype(int) + x[:, 1], 0, 2)
    row, col = np.nonzero(x)
    w, t = toxicity.fit_cumulative_link(row, col, 5, grades, 3, steps=600, ridge=1e-4)
    m = toxicity.Model(1, np.arange(5), w, t, 0.0, {})
    severity, best = m.severity(x @ w)
    assert t[0] < t[1] and (best == grades).mean() > 0.97 and abs(severity - grades).mean() < 0.15


# -- pipeline ----------------------------------------------------------------

def test_stages_take_edge_rows(spark, docs, empty, tmp_path):
    labels = spark.createDataFrame([(3, 0), (4, 0), (20, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, frame in (("docs", docs), ("empty", empty)):
        now = frame
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < 4:
                assert out.columns == frame.columns
            out.write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}{k}")
        assert (now.count() == 0) == (name == "empty")


def test_mixing_query_reads_the_written_curriculum(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 3}") for i in range(60)] + [(3, None, None), (4, "w w", "s1"), (4, "w w", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plans = mixing.plan(docs).collect()
    mix = mixing.curriculum(docs)
    copies = mix.collect()
    assert sum(r.words for r in copies) == sum(r.taken for r in plans)
    assert sorted(r.position for r in copies if r.position is not None) == sorted(p for r in plans for p in r.positions)
    made = []
    monkeypatch.setattr(mixing, "curriculum", lambda *a, **b: made.append(1) or mix)
    got = queries.op5_mixing(spark, str(tmp_path)).collect()
    assert made  # before: the query read the plan and no mix was made
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], r[5] if r[5] is not None else -1)
    want = [(r["_id"], r.size, r.source_size, r.target, r.taken, r.positions[0] if r.positions else None) for r in plans]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
