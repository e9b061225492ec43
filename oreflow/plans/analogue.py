"""The pipeline's tables as they are played by the tables of a scale-factor folder.

A hit is a lineitem: its part is the control (brand: family, type: subfamily), its supplier the host,
its order the page.  Distances, functions and literals are made from its numbers and flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_counts
from ..session import materialised

#: What makes a hit of a lineitem l and its part p, for DuckDB.
HITS_SQL = """hits AS (
  SELECT 'https://controls.example/' || p_partkey AS control_url, 'https://s' || l_suppkey || '.example/js/' || (l_partkey % 7) || '.js' AS origin_url,
         's' || l_suppkey AS cited_on_host, '/' || l_orderkey AS cited_on_path, 'https://s' || l_suppkey || '.example/' || l_orderkey AS cited_on,
         l_orderkey || '-' || l_partkey || '-' || l_linenumber AS xref, l_quantity = 1 AS sha256_matched,
         l_quantity AS ast_dist, round(l_discount * 100, 6) AS function_dist, round(l_tax * 100, 6) AS literal_dist,
         CASE WHEN l_linenumber = 7 THEN CAST([] AS VARCHAR[]) WHEN l_linenumber % 2 = 0 THEN [l_returnflag || l_linestatus, p_type] ELSE [l_returnflag || l_linestatus] END AS diff_functions,
         replace(p_name, ' ', ',') || ',' || lower(p_type) AS diff_literals, l_linenumber AS n_diff_literals,
         l_linenumber % 3 AS literals_not_in_control, l_linenumber % 4 AS literals_not_in_origin, p_brand AS family, p_type AS subfamily, l_shipdate AS created_at
  FROM lineitem JOIN part ON l_partkey = p_partkey
), controls AS (
  SELECT 'https://controls.example/' || p_partkey AS origin, p_brand AS family, p_type AS subfamily, p_size * 100 AS size_bytes, p_size = 1 AS do_not_load FROM part
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        _joined("https://controls.example/", F.col("p_partkey")).alias("origin"),
        F.col("p_brand").alias("family"),
        F.col("p_type").alias("subfamily"),
        (F.col("p_size") * 100).alias("size_bytes"),
        (F.col("p_size") == 1).alias("do_not_load"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier = F.col("l_linenumber"), F.col("l_suppkey")
    flag = F.concat("l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        _joined("https://controls.example/", F.col("p_partkey")).alias("control_url"),
        _joined("https://s", supplier, ".example/js/", F.col("l_partkey") % 7, ".js").alias("origin_url"),
        _joined("s", supplier).alias("cited_on_host"),
        _joined("/", F.col("l_orderkey")).alias("cited_on_path"),
        _joined("https://s", supplier, ".example/", F.col("l_orderkey")).alias("cited_on"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("xref"),
        (F.col("l_quantity") == 1).alias("sha256_matched"),
        F.col("l_quantity").alias("ast_dist"),
        F.round(F.col("l_discount") * 100, 6).alias("function_dist"),
        F.round(F.col("l_tax") * 100, 6).alias("literal_dist"),
        F.when(line == 7, F.array().cast("array<string>")).when(line % 2 == 0, F.array(flag, F.col("p_type"))).otherwise(F.array(flag)).alias("diff_functions"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(","), F.lower("p_type")).alias("diff_literals"),
        line.alias("n_diff_literals"),
        (line % 3).alias("literals_not_in_control"),
        (line % 4).alias("literals_not_in_origin"),
        F.col("p_brand").alias("family"),
        F.col("p_type").alias("subfamily"),
        F.col("l_shipdate").alias("created_at"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as sparse counts of their words; one text for each turn."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return word_counts(rows, ["conv_id", "turn"])


def scripts(rows: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Texts as artefacts: words are calls and literals, words and punctuation are statements."""
    rows = rows.groupBy(key).agg(F.min(text_col).alias("text"))
    counted = word_counts(rows, [key], "text", "calls_by_count")
    n = lambda sign: (F.length("text") - F.length(F.replace("text", F.lit(sign), F.lit("")))).cast("int")
    shapes = rows.select(key, F.sha2("text", 256).alias("sha256"), F.create_map(F.lit("Name"), n(" "), F.lit("Block"), n("."), F.lit("ElementGet"), n(",")).alias("statements_by_count"))
    return counted.join(shapes, key).withColumn("literals_by_count", F.col("calls_by_count"))


def script_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as artefacts, and benchmark items as controls; both are read by several joins."""
    speech = table(spark, sf_dir, "conversations").withColumn("artefact_id", F.concat_ws("/", "conv_id", "turn"))
    a = scripts(speech, "artefact_id").withColumns({
        "url": F.concat(F.lit("https://speech.example/"), F.col("artefact_id")), "origin": F.lit("https://speech.example/"), "js_id": F.substring(F.sha2("artefact_id", 256), 1, 24)})
    b = scripts(table(spark, sf_dir, "benchmark").withColumn("origin", F.concat(F.lit("https://controls.example/"), F.col("item_id"))), "origin")
    b = b.withColumns({"do_not_load": F.lit(False), "size_bytes": F.lit(2000), "family": F.lit("benchmark"), "subfamily": F.lit("benchmark")})
    return materialised(a, "artefacts"), materialised(b, "controls")
