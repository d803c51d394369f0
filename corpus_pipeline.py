"""A corpus pipeline of five stages, each of which calls one operator of tidemark.llm.

Quality classifier, exact dedup, near-dedup, mixing of sources to target weights, and BPE encoding. Each stage
is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, mixing, near_dedup, pu_quality
from tidemark.sources.scratch import delete, scope, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more; it learns from the labels in sf_dir.

    As in all stages: null and empty texts are texts of no words, long ones count whole, rows that repeat are rows of
    their own, an empty table stays empty, and further columns of any name pass through.
    """
    model = pu_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return pu_quality.good_rows(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty), the row with the largest doc_id, the last by file and place among equal ones."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the least doc_id."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: not at all, once or twice."""
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, a row for each row of docs."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: SQL can't express the classifier or the signatures; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir, each but the last written to the shared folder and read again.

    What a stage leaves in the shared folder goes when its result is written, and that goes when the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        with scope(spark):
            done = stage(spark, docs, sf_dir)
            done.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(done.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
