"""The registered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary, embeddings, langid, media, packing, quality, simhash, spiece, urlfilter, warc
from .common import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(media.media_column(table(spark, sf_dir, "documents")), "media")
    return media.media_features(stored)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.digests(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_files(table(spark, sf_dir, "documents"))


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_png_media": op2_png_media,
    "op3_packing": op3_packing,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_bloom_cascade": op5_bloom_cascade,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_token_files": op9_token_files,
    "op10_metric_join": op10_metric_join,
}

ORACLE_SQL: dict[str, str] = {
    "op5_bloom_cascade": urlfilter.ORACLE_SQL,
}
