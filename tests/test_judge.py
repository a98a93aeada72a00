import json

from pyspark.sql import functions as F

from scribeval.functions import judge as J

GOOD = {"word_count": 7, "no_penalty_errors": ["a"], "major_errors": ["b"], "minor_errors": ["c"],
        "total_penalty": 1.5, "laser_score": 0.786}


def _parse(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r.reply for r in J.with_parsed_reply(df, "raw", "reply").orderBy("i").collect()]


def test_canonical_reply(spark):
    (r,) = _parse(spark, [json.dumps(GOOD)])
    assert r.valid and r.word_count == 7 and r.major_errors == ["b"] and abs(r.laser_score - 0.786) < 1e-12


def test_alias_keys_and_clamp(spark):
    aliased = {"word_count": 5, "non_penalizable_errors": [], "major_penalizable_errors": [],
               "minor_penalizable_errors": [], "total_penalty": 0.0, "score": 0.7}
    high = dict(GOOD, laser_score=1.5)
    low = dict(GOOD, laser_score=-0.2)
    a, h, lo = _parse(spark, [json.dumps(aliased), json.dumps(high), json.dumps(low)])
    assert a.valid and a.laser_score == 0.7
    assert h.laser_score == 1.0 and h.raw_score == 1.5
    assert lo.laser_score == 0.0


def test_lists_given_as_strings(spark):
    rep = dict(GOOD, no_penalty_errors="some error", major_errors=json.dumps(["real error"]), minor_errors="")
    (r,) = _parse(spark, [json.dumps(rep)])
    assert r.no_penalty_errors == ["some error"] and r.major_errors == ["real error"] and r.minor_errors == []


def test_invalid_and_null(spark):
    missing = {k: v for k, v in GOOD.items() if k != "total_penalty"}
    wrong = dict(GOOD, word_count="many")
    m, w, n, broken = _parse(spark, [json.dumps(missing), json.dumps(wrong), None, "{not json"])
    assert not m.valid and not w.valid and not broken.valid
    assert not n.valid and n.reason == "empty content"


def test_shortcut_and_feedback(spark):
    df = spark.createDataFrame([("", "x"), ("a b c", ""), ("a b", "a c")], "r string, h string")
    sc = df.select(J.shortcut(F.col("r"), F.col("h")).alias("s")).collect()
    assert sc[0].s.laser_score == 1.0 and sc[0].s.word_count == 0
    assert sc[1].s.laser_score == 0.0 and sc[1].s.major_errors == ["entire sentence missing (3 words)"]
    assert sc[2].s is None
    fb = spark.createDataFrame([(10, [], [], ["x"], 1.5, 0.7), (4, ["n"], ["m1", "m2"], [], 2.0, 0.5),
                                (3, ["uh"], [], [], 0.0, 1.0)],
                               "wc int, np array<string>, ma array<string>, mi array<string>, p double, s double")
    rows = fb.select(J.feedback(F.col("wc"), F.col("np"), F.col("ma"), F.col("mi"), F.col("p"), F.col("s"))
                     .alias("f")).collect()
    assert rows[0].f.startswith("MINOR — 1 minor error(s)")
    assert "Score: 0.700 (1.5/10 word penalties)" in rows[0].f
    assert "PERFECT" not in rows[0].f
    assert rows[2].f.startswith("ACCEPTABLE — 1 no-penalty difference(s)")
    assert rows[2].f.endswith("PERFECT — No errors detected. Transcription matches reference exactly.")
    assert rows[1].f.startswith("CRITICAL — 2 major error(s)") and "m1; m2" in rows[1].f
    assert "PERFECT" not in rows[1].f


def test_num_clamp_filters_written_scores(spark, tmp_path):
    # before: the filter held a copy of the whole reply, quadratic in a line's words
    from scribeval.plans import judging
    line = " ".join(f"w{i}" for i in range(40))
    spark.createDataFrame([(i, "en", line) for i in range(10)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, line)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = judging.num_clamp(spark, str(tmp_path))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    whole = judging.parsed_replies(spark, str(tmp_path)).select("sample_id", "reply.raw_score", "reply.laser_score").collect()
    assert sorted((r[0], round(r[1], 9), round(r[2], 9)) for r in whole if r[1] is not None) == sorted(map(tuple, out.collect()))


def test_edited_text_and_filler_guard(spark):
    from scribeval.functions.normalize import _GUARDS, REGEX_STEPS_HEAD, normalize_stages, normalize_string
    from scribeval.sources.fixtures import edited_text
    words = [f"w{i}" for i in range(60)]

    def edited(w):
        out = []
        for i, x in enumerate(w):
            out += [] if i % 7 == 3 else ["zz" if i % 11 == 5 else x] + (["uh"] if i % 13 == 6 else [])
        return " ".join(out)
    rows = [(words[:n],) for n in (0, 1, 4, 7, 20, 60)] + [(["", "a"],)]
    for w, text in spark.createDataFrame(rows, "w array<string>").select("w", edited_text(F.col("w"))).collect():
        assert text == edited(w)
    assert REGEX_STEPS_HEAD[2][0] in _GUARDS  # before: searched in every text
    texts = [(t,) for t in ("hmm yes", "mm mhm mmm", "uh, um", "hummed uhuru", "no", "UM so", None)]
    df = normalize_stages(spark.createDataFrame(texts, "t string"), "t", "got").withColumn("want", normalize_string(F.col("t")))
    assert all(r.got == r.want for r in df.collect())
