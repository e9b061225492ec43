"""The stages of the corpus pipeline: operators of this subpackage as (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of docs, whatever they are called and whatever nulls they hold; an
empty table gives an empty table.  Texts are whole, of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, packing, quality, shingles
from .common import cut, marked


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is recognised; null, empty and letterless texts and undecided ones go.

    Without any document that has a language, none is recognised and none stays.  Equal rows share their fate.
    """
    return langid.keep(docs, langid.train(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from labels of these documents, predicts as good.

    Null texts count as empty, and an empty text is judged like any other.  Without labels the score of
    all is 0.5, and all stay.  Equal rows share their fate.
    """
    return quality.keep(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; of rows that repeat it, one.

    Texts are linked if the sets of their five-word shingles have a similarity of 0.8 or more, found by
    operator 7's method on SimHash fingerprints of 192 bytes, as 64 bits cannot tell it.  Null, empty and blank texts are one group.  Of different rows
    with one id in a group the one with the smallest hash stays; groups that share their smallest id keep
    a row each.  Rows without id cannot be told apart and stay.
    """
    whole = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    found = shingles.near_duplicates(docs.select("doc_id", whole.alias("row"), "text")).where("doc_id is not null")
    found = cut(found, "found")
    groups = found.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("members"))
    groups = cut(groups, "groups")
    # rows without company stay as they are; the others, and few more, are shuffled for the choice
    company = marked(found, "component", groups.where("members > 1").select("component"), "company").where("company")
    name, chosen = f"row_{uuid.uuid4().hex}", f"chosen_{uuid.uuid4().hex}"
    rows = marked(docs.withColumn(name, whole), name, company.select("row"), chosen)
    first = groups.select("first.doc_id", F.col("first.row").alias(name))
    kept = rows.where(chosen).join(first, ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return kept.select(docs.columns).unionByName(rows.where(f"doc_id is null or not {chosen}").select(docs.columns))


def packing_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows; null and empty texts are an end id alone, repeated rows are packed each."""
    return packing.pack(docs)
