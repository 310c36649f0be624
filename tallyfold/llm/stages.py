"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) -> the documents that stay, with the columns of documents.

What holds for all: a null in any column, an empty or a very long text and a column with a name of the
operator's own are taken as they are; an empty table gives an empty one; columns come back under their own names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, linededup
from .common import scratch_path


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty text, no letter) go. Repeated rows all stay; rows without a lang or doc_id teach nothing."""
    return langid.identify(docs, langid.fit(docs)).where(F.col("lang_pred") != langid.UND).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id also holds go; n_chars is counted anew.

    A null id is the largest; rows of one id keep a line that it is the first to hold; a null text comes back
    empty. No row goes.
    """
    out = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays; of repeated rows any one.

    A null text is in no group and stays; so does every row of a text that is like no other.
    """
    from . import minhash

    return minhash.keep_first(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; repeated rows go or stay together, null and empty texts stay."""
    from . import decontam

    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes that they decode to, of every row; a null text is empty."""
    return bpe.digest(docs)


def run(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    """Each stage but the last is written to the shared folder, and the next one reads it. An empty table runs through all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in stages[:-1]:
        at = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(at)
        docs = spark.read.parquet(at)
    return stages[-1][1](spark, docs, sf_dir)
