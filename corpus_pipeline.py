"""A training-data pipeline over the documents table: four stages, each an operator of oreflow.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreflow.llm import stages
from oreflow.session import drop, materialised, release, standing

STAGES = [
    ("language_id", stages.language_id),
    ("quality_classifier", stages.quality_classifier),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("packing", stages.packing_windows),
]

#: A convolutional network, a kernel classifier and a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written as Parquet and read again by the next.

    What a stage leaves behind, and its input if that was written here, is deleted once its result is written.
    """
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), False
    for name, stage in STAGES[:-1]:
        before = standing()
        made = materialised(stage(spark, docs, sf_dir), name)
        release(spark, before, made)
        if written:
            drop(docs)
        docs, written = made, True
    return STAGES[-1][1](spark, docs, sf_dir)
