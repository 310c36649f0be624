"""A corpus pipeline of five stages; each works on all rows that the one before it kept.

Documents are kept whole unless a stage names a reason: no language (8), repeated lines (10: the lines
go), near copies (6: one of each group stays), benchmark passages (4). The last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfold.llm import stages

STAGES = [
    ("language ID", stages.keep_identified),
    ("line dedup", stages.drop_repeated_lines),
    ("MinHash near-dedup", stages.keep_one_of_each_group),
    ("benchmark decontamination", stages.drop_contaminated),
    ("byte-level BPE", stages.encode),
]

#: SQL has no language models, signatures or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir, STAGES)
