"""Topics: streams of JSON records, read from and written to files, tables or a broker.

A topic is a folder of JSON lines (or Parquet) here; with the broker's connector on the class path the
same options read and write it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class TopicOptions:
    """Where a topic is and how much of it is read."""

    path: str | None = None
    bootstrap: str | None = None
    topic: str | None = None
    group: str | None = None
    start: str = "earliest"
    max_per_batch: int = 2000

    def __post_init__(self) -> None:
        if self.start not in ("earliest", "latest"):
            raise ValueError("start is earliest or latest")
        if (self.path is None) == (self.bootstrap is None):
            raise ValueError("either a path or a broker is needed")


def encode(*columns: str | Column) -> Column:
    """A record as compact JSON."""
    return F.to_json(F.struct(*columns))


def decode(value: Column, schema: T.StructType) -> Column:
    """A JSON record as a struct; what is no record becomes nulls."""
    return F.from_json(value.cast("string"), schema, {"mode": "PERMISSIVE"})


def read_batch(spark: SparkSession, options: TopicOptions, schema: T.StructType) -> DataFrame:
    if options.path:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").json(options.path)
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", options.bootstrap).option("subscribe", options.topic).option("startingOffsets", options.start)
    return reader.load().select(decode(F.col("value"), schema).alias("v")).select("v.*")


def read_stream(spark: SparkSession, options: TopicOptions, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    if options.path:
        # output of programs lies in a folder for each of their batches
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
        return reader.json(options.path)
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", options.bootstrap).option("subscribe", options.topic)
    reader = reader.option("startingOffsets", options.start).option("maxOffsetsPerTrigger", options.max_per_batch)
    if options.group:
        reader = reader.option("kafka.group.id", options.group)
    return reader.load().select(decode(F.col("value"), schema).alias("v")).select("v.*")


def keyed(records: DataFrame, key: str) -> DataFrame:
    """Records as key and value columns for a topic sink, dealt by the key."""
    return records.select(F.col(key).cast("string").alias("key"), encode(*records.columns).alias("value")).repartition("key")


def write_batch(records: DataFrame, options: TopicOptions, key: str | None = None) -> None:
    if options.path:
        records.write.mode("append").json(options.path)
        return
    rows = keyed(records, key) if key else records.select(encode(*records.columns).alias("value"))
    rows.write.format("kafka").option("kafka.bootstrap.servers", options.bootstrap).option("topic", options.topic).save()


def next_artefacts(records: DataFrame, predicate: Column, most: int | None = None) -> DataFrame:
    """The records that pass a predicate, and of those at most so many."""
    rows = records.where(predicate)
    return rows.limit(most) if most is not None else rows


def dump(records: DataFrame, metadata: list[str] | None = None, most: int | None = None) -> DataFrame:
    """One JSON text per record, with metadata columns only if asked for."""
    hidden = {"key", "topic", "partition", "offset", "timestamp"} - set(metadata or ())
    rows = records.select(encode(*(c for c in records.columns if c not in hidden)).alias("value"))
    return rows.limit(most) if most is not None else rows


def topics(spark: SparkSession, database: str = "default") -> list[str]:
    """The names of stored topics."""
    return sorted(t.name for t in spark.catalog.listTables(database))


def seed_urls(spark: SparkSession, path: str, scheme: str = "https") -> DataFrame:
    """One url for each line that is not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.concat(F.lit(f"{scheme}://"), F.trim("value")).alias("url"))


def fan_out(routes: dict[str, Column], sinks: dict[str, Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that sends the rows of each route to its sink; the batch is computed once."""

    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            for name, condition in routes.items():
                sinks[name](batch.where(condition))
        finally:
            batch.unpersist()

    return run
