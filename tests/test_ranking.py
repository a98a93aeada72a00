from pyspark.sql import Window
from pyspark.sql import functions as F

from scribeval.operators.ranking import range_row_number


def test_range_row_number_equals_window_on_skewed_keys(spark):
    # one key holds a third of the rows
    rows = [(0 if i % 3 == 0 else i % 17, (i * 7919) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = range_row_number(df, ["v", "id"], ["g"], out="rn", num_partitions=6)
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("rn", F.row_number().over(w))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_range_row_number_global(spark):
    df = spark.range(500).withColumn("k", (F.col("id") * 37) % 500)
    got = range_row_number(df, ["k"], None, out="rn", num_partitions=4)
    assert sorted(r.rn for r in got.collect()) == list(range(1, 501))
    assert all(r.rn == r.k + 1 for r in got.collect())
