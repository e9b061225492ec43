"""Scripts and controls from files, catalogs of files, and table sinks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url


@dataclass
class StoreOptions:
    """Where tables are kept."""

    warehouse: str

    def table(self, name: str) -> str:
        return f"{self.warehouse.rstrip('/')}/{name}"


def binary_files(spark: SparkSession, root: str, pattern: str = "*.js") -> DataFrame:
    """path, size and code of all files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.col("length").alias("size_bytes"), F.col("content").alias("code"))


def artefact_files(artefacts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """artefacts with the code of the file at their path below root."""
    wanted = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("path", "^/+", ""))
    own = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("_at"), "code")
    return artefacts.withColumn("_at", wanted).join(own, "_at").drop("_at")


def _below(path: Column, root: str) -> Column:
    """A path without the folder root, which may be given with or without its scheme."""
    plain = re.sub("^file:(//)?", "", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, "^file:(//)?", ""), rf"^\Q{plain}\E/", "")


def tree_controls(spark: SparkSession, root: str, base_url: str, family: str, release: str) -> DataFrame:
    """Controls from a tree of scripts: the url is the base, the release and the path below root."""
    files = binary_files(spark, root)
    origin = F.concat_ws("/", F.lit(base_url.rstrip("/")), F.lit(release), _below(F.col("path"), root))
    return files.select(F.lit(family).alias("family"), F.lit(release).alias("release"), origin.alias("origin"), "size_bytes", "code")


def plugin_controls(spark: SparkSession, root: str, base_url: str, family: str, variant: str | None = None) -> DataFrame:
    """Controls from tagged releases of a plugin: only files under /tags/<release>/, no translations, of the variant."""
    files = binary_files(spark, root).withColumn("at", _below(F.col("path"), root))
    release, rest = (F.regexp_extract("at", r"(?:^|/)tags/([^/]+)/(.+)$", n) for n in (1, 2))
    rows = files.withColumns({"release": release, "rest": rest}).where(F.col("release") != "")
    rows = rows.where(~url.is_translation(F.concat(F.lit("/"), F.col("rest"))) & url.fits_variant(F.col("rest"), variant))
    origin = F.concat_ws("/", F.lit(base_url.rstrip("/")), F.lit("tags"), "release", "rest")
    return rows.select(F.lit(family).alias("family"), "release", origin.alias("origin"), "size_bytes", "code")


def library_catalog(catalog: DataFrame, base_url: str, variant: str | None = None, version: str | None = None) -> DataFrame:
    """Script urls of a catalog (name, assets: array of version and files), without translations."""
    rows = catalog.select("name", F.explode("assets").alias("asset")).where(url.fits_version(F.col("asset.version"), version))
    rows = rows.select("name", F.col("asset.version").alias("version"), F.explode("asset.files").alias("file"))
    rows = rows.withColumn("url", F.concat_ws("/", F.lit(base_url.rstrip("/")), "name", "version", "file"))
    return rows.where(F.col("file").endswith(".js") & ~url.is_translation(F.col("url")) & url.fits_variant(F.col("file"), variant))


def package_catalog(packages: DataFrame, base_url: str, variant: str | None = None, version: str | None = None) -> DataFrame:
    """Script urls of packages (provider gh or npm, name, versions: array of version and files); gh wins over npm."""
    first = packages.groupBy("name").agg(F.min("provider").alias("provider"))
    rows = packages.join(first, ["name", "provider"]).select("name", "provider", F.explode("versions").alias("v"))
    rows = rows.where(url.fits_version(F.col("v.version"), version)).select("name", "provider", F.col("v.version").alias("version"), F.explode("v.files").alias("file"))
    named = F.concat(F.col("name"), F.lit("@"), F.col("version"))
    rows = rows.withColumn("url", F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("provider"), F.lit("/"), named, F.col("file")))
    return rows.where(F.col("file").endswith(".js") & ~url.is_translation(F.col("url")) & url.fits_variant(F.col("file"), variant))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header; arrays become comma-separated texts."""
    flat = [F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes]
    rows.select(flat).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def pretty(rows: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("value"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions that rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def code_of(scripts: DataFrame, js_id: str) -> DataFrame:
    """The stored bytes of one script, for export."""
    return scripts.where(F.col("js_id") == js_id).select("js_id", "code")
