"""The datasets there are: one registry for the loader, the quota and the runs.

An entry names a table, the configuration and split of its rows, and the
columns that hold the audio and the text.  ``documents`` has one entry for
each of its languages (the configuration; rows without one are ``none``) and
split (``test``: ids that 10 divides, else ``train``), so that every row of
every table is in exactly one entry, which the row itself tells.  The languages
are read from the table; there are as many entries as languages, not as rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


@dataclass(frozen=True)
class DatasetEntry:
    path: str
    config: str | None
    audio_column: str
    text_column: str
    split: str


NO_LANGUAGE = "none"
SPLITS = ("test", "train")
TEST_EVERY = 10
OTHERS = {
    "benchmark": DatasetEntry("benchmark", None, "item_id", "text", "test"),
    "conversations": DatasetEntry("conversations", None, "turn", "text", "test"),
    "pages": DatasetEntry("pages", None, "page_id", "html", "test"),
}
#: Tables whose texts are evaluated line by line.
EVALUATED = ("documents", "benchmark")


def split_of(doc_id: Column) -> Column:
    return F.when(doc_id % TEST_EVERY == 0, "test").otherwise("train")


def document_dataset(doc_id: Column, lang: Column) -> Column:
    """The name of a document's entry."""
    return F.concat(F.lit("documents-"), F.coalesce(lang, F.lit(NO_LANGUAGE)), F.lit("-"), split_of(doc_id))


def registry(spark: SparkSession, sf_dir: str) -> dict[str, DatasetEntry]:
    """All entries by name, in registry order."""
    lang = F.coalesce("lang", F.lit(NO_LANGUAGE))
    found = read_table(spark, sf_dir, "documents").select(lang.alias("lang")).distinct().collect()
    documents = {f"documents-{r.lang}-{s}": DatasetEntry("documents", r.lang, "doc_id", "text", s) for r in found for s in SPLITS}
    return dict(sorted(documents.items())) | OTHERS


def registry_frame(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> DataFrame:
    """dataset and position (0-based, in registry order) of the entries, or of
    those of some tables."""
    names = [n for n, e in registry(spark, sf_dir).items() if tables is None or e.path in tables]
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "dataset string, position int")
