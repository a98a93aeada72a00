import random

from pyspark.sql import functions as F

from scribeval.functions.normalize import split_words
from scribeval.functions.wer import wer_from, with_word_distance
from scribeval.operators.scoring import score_wer


def dp(a, b):
    prev = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        cur = [i] + [0] * len(b)
        for j in range(1, len(b) + 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
        prev = cur
    return prev[-1]


def _wer(spark, pairs):
    df = spark.createDataFrame(pairs, "reference string, text string")
    return [r.wer for r in score_wer(df).collect()]


def test_wer_edge_cases(spark):
    got = _wer(spark, [("hello world", "hello world"), ("hello world", "hello there"),
                       ("", "anything here"), ("hello world", ""), (None, "x"), ("a b", "a b c d e f")])
    assert got == [0.0, 0.5, 0.0, 1.0, 0.0, 2.0]


def test_word_distance_matches_dp_on_random_pairs(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(40)]
    pairs = []
    for _ in range(200):
        a = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "r string, h string").select(
        "r", "h", split_words(F.col("r")).alias("rt"), split_words(F.col("h")).alias("ht"))
    rows = with_word_distance(df, "rt", "ht", "d").collect()
    for r in rows:
        assert r.d == dp(r.r.split(), r.h.split())


def test_supplementary_plane_codes(spark):
    # every word is coded above U+FFFF; a long pair checks the coding end to end
    a = [f"x{i}" for i in range(3000)]
    b = a[:-1] + ["changed"]
    df = spark.createDataFrame([(a, b)], "rt array<string>, ht array<string>")
    d = with_word_distance(df, "rt", "ht", "d").select("d", wer_from(F.col("d"), F.col("rt"), F.col("ht")).alias("w"))
    r = d.first()
    assert r.d == 1 and abs(r.w - 1 / 3000) < 1e-12


def test_codes_are_hashes_unless_two_words_share_one(spark):
    from scribeval.functions.wer import CODES
    # before: each word searched in the vocabulary
    ids = spark.range(4000).select(F.concat(F.lit("w"), "id").alias("w")).withColumn("c", F.pmod(F.xxhash64("w"), F.lit(CODES)))
    same = ids.groupBy("c").agg(F.sort_array(F.collect_list("w")).alias("ws")).where("size(ws) > 1").first().ws
    pairs = [([same[0], "a"], [same[1], "a"]), (["a", "b", "c"], ["a", "c"]), ([], ["a"]), (["é"], ["e"])]
    df = spark.createDataFrame(pairs, "rt array<string>, ht array<string>")
    out = with_word_distance(df, "rt", "ht", "d")
    assert [r.d for r in out.collect()] == [1, 1, 1, 1]
    assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()


def test_large_stages_are_not_interpreted(spark):
    # before: 65,535, and the normaliser's stage was too large for the JVM's compiler
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_normaliser_stages_equal_the_plain_chain(spark):
    from scribeval.functions.normalize import normalize_stages, normalize_string, normalized_words
    rnd = random.Random(3)
    pieces = ["uh", "um", "mm", "mmm", "hmm", "h", "m", "'", "won't", "'s", " ", "  ", "\t", "\n", "\r", "\x0b", "(", ")", "[", ">", "1", "2",
              ",", ".", "%", "$", "€", "é", "ß", "日本", "_", "-", "mr", "A", "UM", "😀", "٣", "\x00", "x"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(3000)] + [None, "", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    want = [r[0] for r in df.select(normalize_string(F.col("t"))).collect()]
    assert [r[0] for r in normalize_stages(df, "t", "got").select("got").collect()] == want
    assert [" ".join(r[0]) for r in normalized_words(df, "t", "got").select("got").collect()] == want
