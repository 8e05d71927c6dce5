"""A corpus pipeline of five stages over the table `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscope.llm import common, exact_dedup, jaccard_join, language_id, mixing, packing

#: Each function takes (spark, docs, sf_dir) and returns the next stage's documents, the last one the packed pieces.
STAGES = [
    ("language_id", language_id.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", jaccard_join.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Compression, gradient descent and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
