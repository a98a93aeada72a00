"""The registered ``opN_<name>`` queries: each applies one operator to its
whole table and derives the contract's columns from the operator's output."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import read_table
from . import oracle
from . import hard_negatives, importance, jaccard_join, lattice_dedup, mixing, packing, quality, token_files, topk_search, toxicity, url_filter, warc
from .substring_dedup import remove_repeats


TOKENIZER = "byte_bpe_50k.json"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the session's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to record files and read back."""
    path = scratch(spark, "token-files")
    token_files.write(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.read(spark, path)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every 50th vector, by integer inner product."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


#: The rules that the URL query judges by (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(read_table(spark, sf_dir, "pages"), rules)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), length=1024)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, and where it first stands: read
    from the copies in training order."""
    mix = mixing.curriculum(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    document = ["source", "_bucket", "_no", "_id", "_row", "size", "source_size", "target"]
    out = mix.groupBy(*document).agg(F.sum("words").alias("taken"), F.min("position").alias("position"))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows of ``documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs, window=20, carry=[], keep_text=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine >= 0.95."""
    return lattice_dedup.dedup(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    path = scratch(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` under 4-word Jaccard similarity >= 0.85."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.link(docs, shingle=4, percent=85)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by the model fitted on ``labels``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", *toxicity.RESULT)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of 5 % of ``documents`` towards the texts of ``benchmark``."""
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                               percent=5, least_words=20, seed=42)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by the model fitted on the labels that are
    not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id")))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, some labels made wrong first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label,
                               positives=5, negatives=10, least=30, most=90, scale=256.0)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_topk_search": op2_topk_search,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_lattice_dedup": op7_lattice_dedup,
    "op8_warc": op8_warc,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op2_topk_search": oracle.TOPK_SEARCH,
    "op3_url_filter": oracle.URL_FILTER,
    "op7_lattice_dedup": oracle.LATTICE_DEDUP,
    "op8_warc": oracle.WARC,
    "op5_mixing": oracle.MIXING,
    "op6_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op9_jaccard_join": oracle.JACCARD_JOIN,
    "op11_importance_resampling": oracle.IMPORTANCE,
    "op13_hard_negatives": oracle.HARD_NEGATIVES,
}
