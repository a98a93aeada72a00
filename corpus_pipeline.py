"""The corpus pipeline: documents to packed training sequences.

Five stages, each a function of (spark, docs, sf_dir); each result is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``.

1. toxicity: documents that the severity model rejects go;
2. jaccard: one document of each group of near copies stays (Jaccard
   similarity of five-word shingles of at least 0.8);
3. substrings: words of repeated 20-word windows go from the texts;
4. mixing: documents are repeated or left out to meet the sources' targets,
   and sorted by training position;
5. packing: the texts, in that order, become sequences of at most 1024 tokens
   (one row per piece).  Files are read in any order; the written order is in
   the sequences' numbers (file, row, place), without a shuffle.

There is no SQL twin (the first stage is a fitted model); ``tests/llm`` holds
every stage against a brute-force version.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeval.llm import jaccard_join, keep, mixing, packing, substring_dedup, toxicity
from scribeval.session import checkpoint_dir, configure
from scribeval.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    name = keep.named(docs)
    groups = jaccard_join.link(docs.select(name.alias("doc_id"), "text"), shingle=5, percent=80)
    return keep.one_of_each(docs, groups, name=name)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    # packed, so that no column of the documents clashes with the operator's
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    out = substring_dedup.remove_repeats(docs.select("doc_id", "text", rest.alias("_rest_of_it")), window=20)
    cut = F.col("n_removed") > 0
    columns = {c: F.col("_rest_of_it")[c] for c in docs.columns}
    columns |= {"doc_id": F.col("doc_id"), "text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        n_chars = columns["n_chars"]
        columns["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    return out.select(*[columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return mixing.training_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), length=1024, places=packing.written_places(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_near_copies),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result is the last stage's."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
