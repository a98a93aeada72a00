import random

from pyspark.sql import functions as F

from scribeval.operators.search import search_texts, split_lines, window_lines, windows_of


def brute(lines, query):
    words = query.lower().split()
    scored = [(sum(1 for w in words if w in ln.lower()), i) for i, ln in enumerate(lines)]
    scored = [s for s in scored if s[0] > 0]
    scored.sort(key=lambda x: (-x[0], x[1]))
    seen, out = set(), []
    for _s, i in scored:
        if i in seen:
            continue
        start, end = max(0, i - 2), min(len(lines), i + 10)
        seen.update(range(start, end))
        out.append((i, start, end))
        if len(out) >= 15:
            break
    return out


def test_greedy_windows_match_brute_force(spark):
    rnd = random.Random(11)
    docs = {}
    for d in range(6):
        n = rnd.randint(1, 400)
        docs[d] = [" ".join(rnd.choice(["alpha", "beta", "gamma", "x", "y"]) for _ in range(rnd.randint(0, 4)))
                   for _ in range(n)]
    rows = [(d, "\n".join(lines) + "\n") for d, lines in docs.items()]
    df = spark.createDataFrame(rows, "doc_id long, body string")
    for limit in (15, 3):
        found = search_texts(df, "alpha Beta", limit)
        got = {}
        for r in windows_of(found).collect():
            got.setdefault(r.doc_id, []).append((r.window_no, r.hit_line, r.start, r.end))
        for d, lines in docs.items():
            assert [tuple(x[1:]) for x in sorted(got.get(d, []))] == brute(lines, "alpha Beta")[:limit]
    every = {r.doc_id: r for r in search_texts(df, "alpha Beta", None).collect()}
    for d, lines in docs.items():
        hits = [i for i, ln in enumerate(lines) if any(w in ln.lower() for w in ("alpha", "beta"))]
        assert every[d].total_hits == len(hits)
        covered = {i for w in every[d].windows for i in range(w.start, w.end)}
        assert set(hits) <= covered
    for r in window_lines(found).collect():
        assert docs[r.doc_id][r.line_no] == r.line


def test_lines_end_with_breaks(spark):
    rows = [("",), ("a",), ("a\n",), ("a\n\n",), ("\n",), (None,), ("a\r\nb",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(split_lines(F.col("t")).alias("x")).collect()]
    assert got == [[], ["a"], ["a"], ["a", ""], [""], [], ["a", "b"]]


def test_search_needs_no_shuffle_and_no_python(spark):
    from scribeval.plans import tools
    for q in (tools.q_line_search, tools.win_greedy_windows, tools.join_line_window, tools.set_covered_lines):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
