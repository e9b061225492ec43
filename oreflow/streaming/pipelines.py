"""Streams: bounded or endless runs of the batch operators, de-duplication and counters with bounded state."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def run(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str, tail: bool = False) -> StreamingQuery:
    """Run a function on each micro-batch: of what there is now, or on and on with tail.

    A batch's offsets count as read only after its function returned, so it sees every record at least once.
    """
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="5 seconds") if tail else writer.trigger(availableNow=True)).start()


def stop_on_signals(query: StreamingQuery, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGTERM, signal.SIGHUP)) -> None:
    """Let the signals end a stream after its batch; the next run goes on from the checkpoint."""
    for number in signals:
        signal.signal(number, lambda *_: query.stop())


def first_seen(stream: DataFrame, keys: list[str], time: str, delay: str = "30 days") -> DataFrame:
    """The first record of each key; a key is forgotten when the watermark has passed it by the delay."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, key: str) -> DataFrame:
    """Records of each key so far."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, key: str, time: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Records of each key and window of time; windows close with the watermark."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select("window.start", key, "n")


def count_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows of a batch table with batch: numbers of groups of `size` consecutive rows.

    Ranks come from range partitions and their sizes, not from one sorted task.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_first"))
    out = ordered.join(F.broadcast(firsts), "_part").withColumn("batch", F.floor((F.col("_first") + F.col("_at")) / size))
    return out.drop("_part", "_at", "_first")


def _host_penalty(ttl_ms: int | None, limit: int) -> StatefulProcessor:
    """The processor of host_penalties.  Its class is local, so that it travels with the query itself."""

    class HostPenalty(StatefulProcessor):
        """A running penalty for each host that ends after a time without visits; large ones are reported when they end."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.total = handle.getValueState("total", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            found = self.total.get()[0] if self.total.exists() else 0
            for part in rows:
                found += int(part["penalty"].sum())
            self.total.update((found,))
            if ttl_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + ttl_ms)
            yield pd.DataFrame({"host": [key[0]], "n": [found], "evicted": [False]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            found = self.total.get()[0] if self.total.exists() else 0
            self.total.clear()
            yield pd.DataFrame({"host": [key[0]], "n": [found], "evicted": [True]} if found > limit else {"host": [], "n": [], "evicted": []})

        def close(self) -> None:
            pass

    return HostPenalty()


def host_penalties(stream: DataFrame, host: str = "host", ttl_ms: int | None = None, limit: int = 100) -> DataFrame:
    """host, n and evicted: running totals of the column penalty, and large totals of hosts that went quiet.

    With ttl_ms a host is forgotten so long after its last visit; its timers keep the stream running, so
    that is for endless runs.  Without, totals stay, and a run over what there is ends.
    """
    processor = _host_penalty(ttl_ms, limit)
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return stream.groupBy(host).transformWithStateInPandas(processor, outputStructType="host string, n long, evicted boolean", outputMode="Update", timeMode=mode)


def split_failures(batch: DataFrame, failed: Column, good: Callable[[DataFrame], None], bad: Callable[[DataFrame], None]) -> None:
    """Send the failed rows of a batch one way and the others another."""
    batch.persist()
    try:
        good(batch.where(~failed))
        bad(batch.where(failed))
    finally:
        batch.unpersist()


def with_dimension(load: Callable[[], DataFrame], on: str, each: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that joins each batch with a dimension as it is then."""

    def run(batch: DataFrame, _: int) -> None:
        each(batch.join(load(), on, "left"))

    return run


class QualityGate:
    """Stops an evaluation after several full batches in a row with too few hits."""

    def __init__(self, batch: int = 2000, least: int = 200, patience: int = 5) -> None:
        self.batch, self.least, self.patience, self.bad = batch, least, patience, 0

    def seen(self, n_records: int, n_hits: int) -> None:
        self.bad = self.bad + 1 if n_records >= self.batch and n_hits < self.least else 0
        if self.bad >= self.patience:
            raise RuntimeError(f"{self.bad} batches in a row had fewer than {self.least} hits")
