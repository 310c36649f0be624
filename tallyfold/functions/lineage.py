"""Where a plan ends and the next one begins."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; without that setting a local master gets one of its own, and a cluster, which has none that all machines share, an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return known or tempfile.mkdtemp(prefix="tallyfold-")


def cut(df: DataFrame) -> DataFrame:
    """df as a table written now: later plans begin there, and a lost executor costs none of it.

    Each step on a long plan analyses it anew, and equalities of named expressions multiply along it; for 81 features
    both take longer than their computation. A checkpoint keeps these equalities, a table does not.
    """
    path = f"{folder(df.sparkSession)}/cut-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
