"""A corpus from documents: quality, near-duplicates, personal data, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import dedup, mixing, packing, pii, quality, registry
from helixspark.llm.shared import staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; those without a doc_id stay, and rows that share one go only if all of them are rejected."""
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = scored.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group (five words, similarity of 0.8).

    Rows are told apart by doc_id and a hash of the text, so those that repeat both share one fate; rows without a doc_id go
    if their group has one, and stay otherwise.
    """
    gone = dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), "text_key").distinct()
    key = F.xxhash64(docs["text"].cast("string"))
    return docs.join(gone.hint("merge"), (key == gone["text_key"]) & docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), "left_anti").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars follows the new text."""
    out = pii.redact(pii.find_spans(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.repeat_taken(mixing.mix_sources(docs)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, registry.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources", mix),
    ("packing", pack),
]

#: SQL can't express the classifier, the banding or the tokenizer; tests compare the operators that they call with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
