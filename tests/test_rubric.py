import functools
import random

import duckdb
import pytest

from scribeval.operators import rubric as R


def points(ref, hyp):
    return (R.alignment_cost(ref.split(), hyp.split()) >> 40) / 2


CASES = [
    ("the healthcare plan", "the health care plan", 0), ("an info graphic here", "an infographic here", 0), ("the a t m", "the atm", 0), ("nba games", "n b a games", 0),
    ("he runs fast", "he run fast", 0), ("he runs fast", "he running fast", 0.5), ("the largest house", "the large house", 0.5),
    ("narrower roads", "narrow roads", 0.5), ("she went home", "she goes home", 0.5), ("stopped there", "stop there", 0.5),
    ("well you know it works", "it works", 0), ("it works", "it i mean works", 0), ("just just just one", "just one", 0),
    ("one more", "uh one more more", 0), ("the full commitment", "full commitment", 0.5), ("filter in data", "filter on data", 0.5),
    ("receive mail", "recieve mail", 1), ("affect change", "effect change", 1), ("beautiful day", "ugly day", 1), ("dispatch", "dispatched", 0.5),
    ("", "", 0), ("", "extra", 1), ("gone word", "", 2), ("kids play", "kid plays", 0), ("spelling counts", "speling counts", 0.5),
]


@pytest.mark.parametrize("ref,hyp,want", CASES)
def test_rules(ref, hyp, want):
    assert points(ref, hyp) == want


def brute(ref, hyp):
    """The definition, move by move."""
    def alone(words, i):
        return int(R._single(words)[i])

    @functools.cache
    def at(i, j):
        if i == j == 0:
            return 0
        out = []
        if i and j:
            out.append(at(i - 1, j - 1) + R.substitution(ref[i - 1], hyp[j - 1]))
        if i:
            out.append(at(i - 1, j) + alone(ref, i - 1))
        if j:
            out.append(at(i, j - 1) + alone(hyp, j - 1))
        if i > 1 and j and ref[i - 2] + ref[i - 1] == hyp[j - 1]:
            out.append(at(i - 2, j - 1) + R.FREE)
        if i and j > 1 and hyp[j - 2] + hyp[j - 1] == ref[i - 1]:
            out.append(at(i - 1, j - 2) + R.FREE)
        if i > 2 and j and "".join(ref[i - 3:i]) == hyp[j - 1]:
            out.append(at(i - 3, j - 1) + R.FREE)
        if i and j > 2 and "".join(hyp[j - 3:j]) == ref[i - 1]:
            out.append(at(i - 1, j - 3) + R.FREE)
        if i > 1 and f"{ref[i - 2]} {ref[i - 1]}" in R.MARKERS:
            out.append(at(i - 2, j) + R.FREE)
        if j > 1 and f"{hyp[j - 2]} {hyp[j - 1]}" in R.MARKERS:
            out.append(at(i, j - 2) + R.FREE)
        return min(out)
    return at(len(ref), len(hyp))


POOL = ("you know i mean sort of the a in on uh and like health care healthcare cat cats run running ran large larger largest affect effect "
        "receive recieve spell spelled x xy y xyx atm a t m box boxes is was walk walked walks").split()


def _pairs(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        ref = [r.choice(POOL) for _ in range(r.randint(0, 12))]
        hyp = [r.choice(POOL) if r.random() < 0.3 else w for w in ref if r.random() > 0.15]
        out.append((ref, hyp))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cost_equals_the_definition(seed):
    for ref, hyp in _pairs(seed, 150):
        assert R.alignment_cost(ref, hyp) == brute(ref, hyp), (ref, hyp)


# -- the same moves in SQL: lists, a row of the table a step

def _in(x: str, words) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def _sql_stem(w: str) -> str:
    cut = " ".join(f"WHEN ends_with({w}, '{e}') AND length({w}) >= {len(e) + R.LEAST_STEM} THEN left({w}, length({w}) - {len(e)})" for e in R.ENDINGS)
    x = f"(CASE {cut} ELSE {w} END)"
    return f"CASE WHEN length({x}) > {R.LEAST_STEM} AND right({x}, 1) = left(right({x}, 2), 1) AND {_in(f'right({x}, 1)', R.DOUBLED)} THEN left({x}, length({x}) - 1) ELSE {x} END"


def duckdb_rubric(src: str) -> list[str]:
    """CTEs that end in ``rubric(key, ref_words, cost)`` for the rows of
    ``src(key, rt, ht)`` (token lists)."""
    pair = lambda a, b: f"{a} || ' ' || {b}"
    single = lambda l, i: (
        f"CASE WHEN {_in(f'{l}[{i}]', R.FILLERS + R.DISCOURSE)} OR ({i} > 1 AND {l}[{i} - 1] = {l}[{i}]) THEN {R.FREE} "
        f"WHEN {_in(f'{l}[{i}]', R.ARTICLES)} THEN {R.MINOR} ELSE {R.MAJOR} END")
    r, h = "w.r", "w.h"
    near = (f"{_in(r, R.PREPOSITIONS)} AND {_in(h, R.PREPOSITIONS)} OR w.rs = w.hs OR {_in(pair(r, h), [' '.join(p) for p in sorted(R._IRREGULAR)])} "
            f"OR (length({r}) >= {R.SPELLING_MIN_LEN} AND abs(length({r}) - length({h})) <= 1 AND levenshtein({r}, {h}) = 1)")
    cost = (f"CASE WHEN {r} = {h} THEN 0 WHEN {r} || 's' = {h} OR {h} || 's' = {r} OR {r} || 'es' = {h} OR {h} || 'es' = {r} THEN {R.FREE} "
            f"WHEN {_in(pair(r, h), R.CONFUSED)} THEN {R.MAJOR} WHEN {near} THEN {R.MINOR} ELSE {R.MAJOR} END")
    return [f"""
rub_words AS (
  SELECT key, rt, ht, list_transform(rt, lambda x: {_sql_stem('x')}) AS rs, list_transform(ht, lambda x: {_sql_stem('x')}) AS hs,
    list_transform(range(1, len(ht) + 1), lambda i: {single('ht', 'i')}) AS ins, list_transform(range(1, len(rt) + 1), lambda i: {single('rt', 'i')}) AS del
  FROM {src}
)""", f"""
rub(key, i, rt, ht, rs, hs, ins, del, p3, p2, p1) USING KEY (key) AS (
  SELECT key, 0, rt, ht, rs, hs, ins, del, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]),
    list_reduce(range(1, len(ht) + 1), lambda a, j: list_append(a, least(a[j] + ins[j],
      CASE WHEN j > 1 AND {_in(pair('ht[j - 1]', 'ht[j]'), R.MARKERS)} THEN a[j - 1] + {R.FREE} ELSE {R.FAR} END)), CAST([0] AS BIGINT[]))
  FROM rub_words
  UNION
  SELECT key, i + 1, rt, ht, rs, hs, ins, del, p2, p1,
    list_reduce(list_transform(range(0, len(ht) + 1), lambda j: struct_pack(j := j, b := least(
        p1[j + 1] + del[i + 1],
        CASE WHEN j > 0 THEN p1[j] + list_transform([struct_pack(r := rt[i + 1], h := ht[j], rs := rs[i + 1], hs := hs[j])], lambda w: {cost})[1] ELSE {R.FAR} END,
        CASE WHEN j > 1 AND rt[i + 1] = ht[j - 1] || ht[j] THEN p1[j - 1] + {R.FREE} ELSE {R.FAR} END,
        CASE WHEN j > 2 AND rt[i + 1] = ht[j - 2] || ht[j - 1] || ht[j] THEN p1[j - 2] + {R.FREE} ELSE {R.FAR} END,
        CASE WHEN i > 0 AND j > 0 AND rt[i] || rt[i + 1] = ht[j] THEN p2[j] + {R.FREE} ELSE {R.FAR} END,
        CASE WHEN i > 1 AND j > 0 AND rt[i - 1] || rt[i] || rt[i + 1] = ht[j] THEN p3[j] + {R.FREE} ELSE {R.FAR} END,
        CASE WHEN i > 0 AND {_in(pair('rt[i]', 'rt[i + 1]'), R.MARKERS)} THEN p2[j + 1] + {R.FREE} ELSE {R.FAR} END))),
      lambda a, x: list_append(a, least(x.b, CASE WHEN x.j > 0 THEN a[x.j] + ins[x.j] ELSE {R.FAR} END,
        CASE WHEN x.j > 1 AND {_in(pair('ht[x.j - 1]', 'ht[x.j]'), R.MARKERS)} THEN a[x.j - 1] + {R.FREE} ELSE {R.FAR} END)), CAST([] AS BIGINT[]))
  FROM rub WHERE i < len(rt)
)""", "rubric AS (SELECT key, len(rt) AS ref_words, p1[len(ht) + 1] AS cost FROM rub)"]


def duckdb_rubric_scores() -> str:
    return """SELECT key AS sample_id, ref_words, (cost >> 40) / 2.0::DOUBLE AS points, (cost >> 20) & 1048575 AS n_major,
(cost >> 40) - 2 * ((cost >> 20) & 1048575) AS n_minor, cost & 1048575 AS n_no_penalty,
round(CASE WHEN ref_words = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - ((cost >> 40) / 2.0::DOUBLE) / ref_words)) END, 9) AS rubric_score
FROM rubric"""


def test_both_engines_agree(spark):
    pairs = _pairs(9, 200)
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "sample_id long, norm_ref string, norm_hyp string")
    got = sorted(map(tuple, R.rubric_scores(df).select("sample_id", "ref_words", "points", "n_major", "n_minor", "n_no_penalty", "rubric_score").collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE src(key BIGINT, rt VARCHAR[], ht VARCHAR[])")
    con.executemany("INSERT INTO src VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    want = con.sql("WITH RECURSIVE " + ",".join(duckdb_rubric("src")) + duckdb_rubric_scores()).fetchall()
    assert got == sorted(want)


def test_long_pairs():
    r = random.Random(1)
    ref = [r.choice(POOL) for _ in range(3000)]
    assert R.alignment_cost(ref, ref[:-1]) <= R.MAJOR and R.alignment_cost([], ref[:100]) == brute([], ref[:100])


def test_many_pairs_together_cost_what_each_costs_alone(monkeypatch):
    rnd = random.Random(9)
    words = "the a and so you know i mean cancer cancers run running bigger big health care healthcare atm t m in on well uh receive recieve".split()
    texts = [[rnd.choice(words) for _ in range(rnd.randint(0, 15))] for _ in range(80)]
    pairs = list(zip(texts, reversed(texts)))
    alone = [R.alignment_cost(*p) for p in pairs]
    for places in (1, 100, 1 << 14):
        monkeypatch.setattr(R, "PLACES", places)
        assert R.alignment_costs(pairs) == alone


def test_related_words_are_all_found():
    rnd = random.Random(10)
    for _ in range(60):
        a = {"".join(rnd.choice("abesd") for _ in range(rnd.randint(1, 7))) for _ in range(25)} | {"is", "in", "affect", "good"}
        b = {w[:k] + rnd.choice(("", "s", "e", "ed", "ing", "es")) + w[k + 1:] for w in a for k in range(len(w) + 1)} - {""} | {"was", "on", "effect", "best"}
        found = {(r, h): c for r, h, c in R._related(dict.fromkeys(a), dict.fromkeys(b))}
        assert found == {(r, h): c for r in a for h in b if r != h and (c := R.substitution(r, h)) < R.MAJOR}


def test_words_of_many_pairs_are_compared_once(monkeypatch):
    calls, known = [], R.substitution
    monkeypatch.setattr(R, "substitution", lambda r, h: calls.append((r, h)) or known(r, h))
    pair = ("the kids walk in large boxes".split(), "a kid walked on larger box".split())
    once = R.alignment_costs([pair])
    alone = len(calls)
    assert alone and R.alignment_costs([pair] * 30) == once * 30 and len(calls) == 2 * alone


def _odd_pairs(seed, n):
    r = random.Random(seed)
    stems = ["q" * 13 + "word", "xyz" * 10, "ab" * 16, "ab" * 17, "loudspeaker" * 4, "\u00e9t\u00e9s", "\U0001f600laughs", "walks", "s", "es", "does"]
    pool = stems + [w + e for w in stems for e in ("s", "es", "ing", "x")] + [w[:k] + w[k + 1:] for w in stems if len(w) > 4 for k in (0, len(w) // 2, len(w) - 1)] + POOL
    for _ in range(n):
        ref = [r.choice(pool) for _ in range(r.randint(0, 14))]
        hyp = [r.choice(pool) if r.random() < 0.4 else w for w in ref if r.random() > 0.15]
        if len(hyp) > 2 and r.random() < 0.5:
            hyp[:2] = ["".join(hyp[:2])]
        yield ref, hyp


@pytest.mark.parametrize("seed", range(3))
def test_long_and_odd_words_cost_what_the_definition_says(seed):
    pairs = list(_odd_pairs(seed, 250))
    assert R.alignment_costs(pairs) == [brute(*p) for p in pairs]


def test_tables_of_32_and_of_64_bits_agree(monkeypatch):
    r = random.Random(4)
    pairs = []
    for n in (200, 250, 256, 300, 240):
        ref = [r.choice(POOL) for _ in range(n)]
        pairs.append((ref, [r.choice(POOL) if r.random() < 0.3 else w for w in ref if r.random() > 0.1]))
    pairs.append((["gone"] * 255, ["there"] * 256))
    mixed = R.alignment_costs(pairs)
    monkeypatch.setattr(R, "SMALL_BITS", 1)
    assert R.alignment_costs(pairs) == mixed


def test_batches_are_taken_together_in_their_order(monkeypatch):
    import pyarrow as pa
    pairs = _pairs(12, 60)
    rows = {"sample_id": list(range(60)), "norm_ref": [" ".join(a) for a, _ in pairs], "norm_hyp": [" ".join(b) if b else None for _, b in pairs]}
    whole = pa.RecordBatch.from_pydict(rows)
    monkeypatch.setattr(R, "WORDS", 100)
    got = [x for o in R._costs([whole.slice(k, 7) for k in range(0, 60, 7)]) for x in o.to_pylist()]
    assert [(x["sample_id"], x["ref_words"], x["cost"]) for x in got] == [(i, len(a), brute(a, b)) for i, (a, b) in enumerate(pairs)]
    assert sum(o.num_rows for o in R._costs([])) == 0


def test_related_words_around_the_longest_are_all_found():
    words = [w for n in range(25, 39) for base in ("ab" * 20, "xyz" * 14, "q" * 40) for w in (base[:n], base[:n - 1] + "t", base[:n] + "s", base[:n] + "es", base[:n] + "t" + "ting")]
    found = {(r, h): c for r, h, c in R._related(dict.fromkeys(words), dict.fromkeys(words))}
    assert found == {(r, h): c for r in dict.fromkeys(words) for h in words if r != h and (c := R.substitution(r, h)) < R.MAJOR}
