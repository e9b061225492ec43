"""The pipeline's daemons: each reads a topic, works on micro-batches and writes topics and tables.

A program's work on one batch is a function of DataFrames, so a run over what there is gives what the batch
operators give.  Each batch's output is a folder of its own (batch=<number>) that a repeated batch replaces:
records are read at least once and written once.  With tail a program goes on until a signal stops it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import text, url
from ..functions.javascript import analysed
from ..operators import crawl, match
from ..session import ship
from ..sources import topics
from . import pipelines

VECTORS = ["statements_by_count", "calls_by_count", "literals_by_count"]
#: What a batch makes: rows by the name of the topic or table that they go to.
Work = Callable[[DataFrame], dict[str, DataFrame]]


@dataclass
class Program:
    """A daemon: its topic, the records there, its work, and the topics among its outputs (the others are tables)."""

    source: str
    schema: T.StructType
    work: Work
    sinks: Sequence[str]
    key: str | None = None
    prepare: Callable[[DataFrame], DataFrame] = lambda stream: stream  # on the stream itself, such as de-duplication
    gate: pipelines.QualityGate | None = None
    gated: str | None = None


def output(warehouse: str, name: str) -> str:
    return f"{warehouse.rstrip('/')}/{name}"


def start(spark: SparkSession, program: Program, warehouse: str, checkpoint: str, tail: bool = False, signals: bool = False) -> StreamingQuery:
    """Run a program over the topics and tables below warehouse; with signals, the usual ones end it after a batch."""
    ship(spark)
    source = topics.TopicOptions(path=output(warehouse, program.source))
    stream = program.prepare(topics.read_stream(spark, source, program.schema))

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            made = program.work(batch)
            for name in program.sinks:
                rows = made[name]
                if program.key and program.key in rows.columns:
                    rows = rows.repartition(program.key)  # records of a key in one file, as in one partition of a topic
                rows.write.mode("overwrite").json(f"{output(warehouse, name)}/batch={number}")
            if program.gate:
                n = batch.count()
                program.gate.seen(n, made[program.gated].count() if program.gated else n)
        finally:
            batch.unpersist()

    query = pipelines.run(stream, each, checkpoint, tail)
    if signals:
        pipelines.stop_on_signals(query)
    return query


def written(spark: SparkSession, warehouse: str, name: str, schema: T.StructType) -> DataFrame:
    """What programs have written to a topic or table."""
    return topics.read_batch(spark, topics.TopicOptions(path=output(warehouse, name)), schema)


def extracted(batch: DataFrame, scripts: DataFrame) -> dict[str, DataFrame]:
    """Scripts of a batch with their count vectors, and the failures with a reason.

    Each script is analysed once, however many records name it.  scripts: js_id and code.
    """
    rows = batch.where(text.javascript_only(F.col("content_type"), F.col("size_bytes")))
    wanted = rows.select("js_id").distinct()
    known = scripts.select("js_id", "code").join(wanted, "js_id", "left_semi").dropDuplicates(["js_id"])
    made = known.select("js_id", analysed(F.col("code")).alias("_a"))
    out = rows.join(made, "js_id", "left")
    reason = F.when(F.col("_a").isNull(), "the script is not stored").when(F.col("_a.failed"), F.concat(F.lit("the script cannot be analysed: "), F.coalesce("_a.stderr", F.lit(""))))
    out = out.withColumn("reason", text.shortened(reason))
    good = out.where("reason is null").select(*batch.columns, *(F.col(f"_a.{c}").alias(c) for c in VECTORS))
    return {"analysis-results": good, "feature-extraction-failures": out.where("reason is not null").select(*batch.columns, "reason")}


def features(scripts: DataFrame) -> Program:
    """Artefacts to count vectors; content that was seen within thirty days is not analysed again."""

    def once(stream: DataFrame) -> DataFrame:
        # equal hash, md5 and size: a collision of hashes alone is other content
        timed = stream.withColumn("seen", F.current_timestamp())
        return pipelines.first_seen(timed, ["sha256", "md5", "size_bytes"], "seen").drop("seen")

    return Program("visited", schemas.JAVASCRIPT_ARTEFACT, lambda b: extracted(b, scripts), ["analysis-results", "feature-extraction-failures"], "sha256", once)


ANALYSED = T.StructType([*schemas.JAVASCRIPT_ARTEFACT.fields, *schemas.ANALYSIS.fields])


def evaluate(controls: DataFrame, max_distance: float = 300.0, strategies: Sequence[str] = ("ast", "calls"), gate: pipelines.QualityGate | None = None) -> Program:
    """Analysed artefacts to their best controls; batches with too few hits end the run."""

    def work(batch: DataFrame) -> dict[str, DataFrame]:
        rows = batch.withColumn("artefact_id", match.hit_id(F.col("url"), F.col("js_id"))).dropDuplicates(["artefact_id"])
        found = match.evaluate(rows, controls, max_distance, strategies)
        records = schemas.conform(found, schemas.BEST_CONTROL)
        return {"javascript-artefact-control-results": records, "hits": records.where("control_url <> ''")}

    return Program("analysis-results", ANALYSED, work, ["javascript-artefact-control-results"], "xref", gate=gate or pipelines.QualityGate(), gated="hits")


def publish(controls: DataFrame, threshold: float = 300.0) -> Program:
    """Evaluated hits to published and bad ones."""

    def work(batch: DataFrame) -> dict[str, DataFrame]:
        good, bad = match.publish(batch, controls, threshold)
        return {"etl-good-hits": schemas.conform(good, schemas.CONTROL_HIT), "etl_bad_hits": bad}

    return Program("javascript-artefact-control-results", schemas.BEST_CONTROL, work, ["etl-good-hits", "etl_bad_hits"], "xref")


def geolocate(addresses: DataFrame, ranges: DataFrame, home: str = "AU") -> Program:
    """Scripts of pages that come from another host, in another country than home; each host once in a batch.

    addresses: host and ip, in place of name lookups; ranges as for crawl.geolocated.
    """

    def work(batch: DataFrame) -> dict[str, DataFrame]:
        rows = batch.select(F.col("url").alias("origin"), F.explode(text.words(F.col("scripts"))).alias("script"), "when")
        rows = rows.withColumn("host", url.hostname(F.col("script"))).where(F.col("host") != F.coalesce(url.hostname(F.col("origin")), F.lit("")))
        first = rows.groupBy("host").agg(F.min(F.struct("when", "origin", "script")).alias("f")).select("host", "f.*")
        ips = addresses.join(first.select("host"), "host", "left_semi").groupBy("host").agg(F.min("ip").alias("ip"))
        placed = crawl.geolocated(ips.select(F.col("ip").alias("address")).distinct(), ranges, "address").select(F.col("address").alias("ip"), "country")
        found = first.join(ips, "host").join(placed, "ip").where(~F.col("country").isin(home, ""))
        return {"javascript-geolocation": schemas.conform(found, schemas.JAVASCRIPT_LOCATION)}

    return Program("html-page-stats", schemas.PAGE_STATS, work, ["javascript-geolocation"])


def upload(host: str) -> Program:
    """Downloads of one crawler's host that know the page they were found on, for the store."""

    def work(batch: DataFrame) -> dict[str, DataFrame]:
        return {"uploads": crawl.uploadable(batch, host)}

    return Program("javascript-artefacts-16", schemas.DOWNLOAD_ARTEFACT, work, ["uploads"], "checksum")
