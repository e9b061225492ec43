"""Running a stream over a table of events to its end and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import new_path


def collected(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The rows that make(stream of the events table) gives, once the stream has read what there is."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]"))
    at = new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        # a repeated batch replaces itself; in complete mode each batch is the whole result
        target = "all" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{at}/out/{target}")

    # a query takes its state store from the session when it starts; the session's own setting comes back
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        running = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(name, before)
    out = spark.read.schema(stream.schema)
    return out.parquet(f"{at}/out/all") if mode == "complete" else out.parquet(f"{at}/out").select(stream.columns)
