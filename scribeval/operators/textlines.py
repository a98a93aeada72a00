"""Lines of texts that are larger than a row, numbered split by split.

A text is a file, or a folder of part files in the order of their names, that
Spark's text reader cuts into splits, so one huge text is read by many tasks.
Inside a split lines are counted as they come; the splits' line counts, summed
up in the order of the splits (one row for each), give every split its first
number.  Lines never meet in one task.

``search_lines`` is the ranked search of ``search.py`` on such rows, and
``range_join`` fetches the lines of its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import keyword_score
from ..session import materialize
from .rangejoin import range_join
from .search import AFTER, BEFORE, kept_windows, query_words

#: Split tables of up to so many rows are broadcast.
SMALL_TABLE = 100_000


def _counted(batches):
    """Adds the place of each line in its split; a split's lines are together."""
    split, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch["file"].dictionary_encode(), batch["start"].to_numpy()
        codes = files.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        at = np.empty(batch.num_rows, np.int64)
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            here = files.dictionary[int(codes[lo])].as_py(), int(starts[lo])
            seen = seen if here == split else 0
            at[lo:hi] = np.arange(seen, seen + hi - lo)
            split, seen = here, seen + hi - lo
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "at"])


def read_lines(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """(text_col, line_no, line) of the text files below ``path``, where each
    folder ``text_col=<name>`` holds one text; ``line_no`` from 0.  Lines end
    with a line feed, with or without a carriage return."""
    raw = spark.read.schema(f"value string, `{text_col}` string").option("lineSep", "\n").text(path)
    rows = raw.select(F.col(f"`{text_col}`").alias("text"), F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("line"))
    # written once: both readings below see the same splits
    lines = materialize(rows.mapInArrow(_counted, "text string, file string, start long, line string, at long"), "lines")
    splits = lines.groupBy("text", "file", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("text").orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(splits.select("text", "file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "splits")
    first = F.broadcast(first) if first.count() <= SMALL_TABLE else first
    return lines.join(first.drop("text"), ["file", "start"]).select(
        F.col("text").alias(text_col), (F.col("first") + F.col("at")).alias("line_no"), "line")


def search_lines(lines: DataFrame, query: str, limit: int = 15, text_col: str = "text") -> DataFrame:
    """(text_col, window_no, hit_line, start, end, n_hits): the windows that
    ``search_texts`` keeps, for lines as rows.  A kept window passes over at
    most one hit for each of its lines, so the best ``limit`` times a window's
    lines of a text's hits hold all that can be kept."""
    score = keyword_score(F.col("line"), query_words(query)).alias("score")
    hits = lines.select(text_col, "line_no", score).where("score > 0")
    order = Window.partitionBy(text_col).orderBy(F.desc("score"), "line_no")
    best = hits.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit * (BEFORE + AFTER))
    found = best.groupBy(text_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("line_no").cast("int").alias("line_no"),
                                                                            "score"))).alias("hits"))
    sizes = lines.groupBy(text_col).agg(F.count("*").cast("int").alias("n_lines"))
    totals = hits.groupBy(text_col).agg(F.count("*").alias("n_hits"))
    kept = found.join(sizes, text_col).join(totals, text_col).withColumn("windows", kept_windows(F.col("hits"), F.col("n_lines"), limit))
    return kept.select(text_col, "n_hits", F.inline("windows"))


def window_lines(lines: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_col, window_no, line_no, line) of every window."""
    return range_join(lines, windows.select(text_col, "window_no", "start", "end"), [text_col], "line_no", "start", "end").select(
        text_col, "window_no", "line_no", "line")
