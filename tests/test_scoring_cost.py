"""Plain texts pass the normaliser's steps that cannot change them."""

from pyspark.sql import functions as F

from scribeval.functions.normalize import NOT_PLAIN, normalize_string, normalized_words

#: Plain texts and texts that are so but for one character or a filler taken out.
PIECES = ["", ".", "..", "a.um.b", "a.um.", "um.", ".uh", "a.", ".a", "a. .b", "a , b.", "a,um,b.", "x;y:z!", "tab\tand\nline.\n", "3.5", "a.5", "1,000",
          "5%", "$3", "it 's", "don't", "(a) b", "[a] b.", "<a>.", "a] b) c>", "é.", "é..", "ß, a.", "A.B. C", "K.", "\x0b.\x1f", "mm.mm.", "a b.", "€5.", "x.\r\n"]


def test_plain_texts_give_the_same_words(spark):
    texts = [a + glue + b for a in PIECES for b in PIECES for glue in ("", " ", ".")] + [None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    # Java's trim and blank runs: the words are the text's parts between blanks
    want = F.array_remove(F.split(F.regexp_replace(normalize_string(F.col("t")), r"[\t\n\f\r ]+", " "), " "), "")
    rows = normalized_words(d.withColumn("want", want), "t", "got").collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows]


def test_plain_texts_are_told_by_one_look(spark):
    d = spark.createDataFrame([("what, a day; no - more.",), ("a1",), ("it's",), ("(a)",), ("é",), ("5%",)], "t string")
    assert [r[0] for r in d.select(~F.rlike("t", F.lit(NOT_PLAIN))).collect()] == [True] + [False] * 5
