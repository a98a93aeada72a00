import duckdb
import pytest
from pyspark.sql import functions as F

from scribeval.functions.numbers import TABLE, duckdb_fold, number_tokens, spark_fold

CASES = {
    "two": "2",
    "one": "1",
    "thirty one": "31",
    "five twenty four": "524",
    "nineteen ninety nine": "1999",
    "twenty nineteen": "2019",
    "two point five million": "2500000",
    "four point two billions": "4200000000s",
    "200 thousand": "200000",
    "200 thousand dollars": "$200000",
    "$20 million": "$20000000",
    "€52.4 million": "€52400000",
    "£77 thousands": "£77000s",
    "two double o eight": "2008",
    "3000 twenty nine": "3000 29",
    "three thousand twenty nine": "3029",
    "forty three thousand two hundred sixty": "43260",
    "forty three thousand two hundred and sixty": "43260",
    "nineteen fifties": "1950s",
    "thirty first": "31st",
    "thirty three thousand and three hundred and thirty third": "33333rd",
    "three billion": "3000000000",
    "millions": "1000000s",
    "july third twenty twenty": "july 3rd 2020",
    "august twenty sixth twenty twenty one": "august 26th 2021",
    "3 14": "3 14",
    "3.14": "3.14",
    "3 point 2": "3.2",
    "3 point 14": "3.14",
    "fourteen point 4": "14.4",
    "two point two five dollars": "$2.25",
    "two hundred million dollars": "$200000000",
    "$20.1 million": "$20100000",
    "ninety percent": "90%",
    "seventy six per cent": "76%",
    "double oh seven": "007",
    "double zero seven": "007",
    "nine one one": "911",
    "nine double one": "911",
    "one triple oh one": "10001",
    "two thousandth": "2000th",
    "thirty two thousandth": "32000th",
    "minus 500": "-500",
    "positive twenty thousand": "+20000",
    "two dollars and seventy cents": "$2.70",
    "two dollars and five cents": "$2.05",
    "two dollars and seventy people": "$2 and 70 people",
    "3 cents": "¢3",
    "three euros and sixty five cents": "€3.65",
    "three and a half million": "3500000",
    "forty eight and a half dollars": "$48.5",
    "10 th": "10th",
    "10th": "10th",
    "oh my and a point per se": "oh my and a point per se",
    "twenty one and seven": "21 and 7",
    "a hundred people and one": "a 100 people and 1",
    "wait one second": "wait 1 2nd",
    "zero": "0",
    "point five": "point 5",
    "two and two": "2 and 2",
    "one hundred and one": "101",
    "nineteen hundred": "1900",
    "two thousand million": "2000000000",
    "nine quadrillion quadrillion": "9000000000000000 1000000000000000",
    "double trouble": "double trouble",
    "minus": "minus",
    "per cent": "per cent",
    "dollars and cents": "dollars and cents",
    "three hundred thousand and five dollars": "$300005",
    "two point": "2 point",
    "five oh five": "505",
    "six hundred and": "600 and",
    "": "",
}
LONG = "one two three four five six seven eight nine one two three four five six seven eight nine"


def _spark(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df = df.withColumn("tokens", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", " ")))
    df = df.withColumn("known", number_tokens("tokens")).withColumn("out", F.array_join(spark_fold("known"), " "))
    return [r.out for r in df.orderBy("i").collect()]


def _duckdb(texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    tokens = "SELECT i, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, ' ') END AS tokens FROM t"
    return [r[0] for r in con.sql(f"SELECT array_to_string({duckdb_fold('tokens')}, ' ') FROM ({tokens}) ORDER BY i").fetchall()]


def test_known_cases(spark):
    assert dict(zip(CASES, _spark(spark, list(CASES)))) == CASES


def test_long_numbers_are_closed_before_they_overflow(spark):
    texts = [LONG, "nine " * 60, "nine hundred quadrillion million billion", "double nine " * 20 + "trillion", "9" * 30 + " thousand"]
    got = _spark(spark, [t.strip() for t in texts])
    assert got[0].replace(" ", "") == "123456789123456789" and got[1].replace(" ", "") == "9" * 60
    assert got == _duckdb([t.strip() for t in texts])


@pytest.mark.parametrize("seed", range(4))
def test_both_engines_agree_on_any_words(spark, seed):
    import random
    r = random.Random(seed)
    pool = list(TABLE) + ["a", "half", "cent", "word", "12", "3.5", "$4", "0.36", "£0.5"] * 3
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(400)]
    assert _spark(spark, texts) == _duckdb(texts)
