"""How rare a differing function is: the share of a subfamily's sites on which it is seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def function_counts(hits: DataFrame, key: str | Column, threshold: float = 50.0) -> DataFrame:
    """Per key and function: distinct hosts and pages among near hits; hits without functions do not count."""
    near = hits.where(F.col("ast_dist") * F.col("function_dist") < threshold)
    rows = near.select(key, "cited_on_host", "cited_on", F.explode("diff_functions").alias("function_name"))
    name = rows.columns[0]
    return rows.groupBy(name, "function_name").agg(F.countDistinct("cited_on_host").alias("n_sites"), F.countDistinct("cited_on").alias("n_pages"))


def subfamily_probability(hits: DataFrame, controls: DataFrame, threshold: float = 50.0, exclude_hash_matches: bool = True) -> DataFrame:
    """function_counts by the subfamily of the hits' controls."""
    rows = hits.where(~F.col("sha256_matched")) if exclude_hash_matches else hits
    known = controls.select(F.col("origin").alias("control_url"), "subfamily")
    return function_counts(rows.drop("subfamily").join(known, "control_url"), "subfamily", threshold)


def function_probabilities(hits: DataFrame, controls: DataFrame, threshold: float = 50.0, exclude_hash_matches: bool = True) -> DataFrame:
    """Per control and function: sites and pages, those of its subfamily, and their ratios.

    Control and subfamily count the same population of hits, so each ratio is in (0, 1].  Controls
    without near hits give no rows; refreshing the table by replacing it drops what they had.
    """
    rows = hits.where(~F.col("sha256_matched")) if exclude_hash_matches else hits
    own = function_counts(rows, "control_url", threshold)
    family = subfamily_probability(hits, controls, threshold, exclude_hash_matches)
    family = family.select("subfamily", "function_name", F.col("n_sites").alias("n_sites_subfamily"), F.col("n_pages").alias("n_pages_subfamily"))
    known = controls.select(F.col("origin").alias("control_url"), "subfamily")
    return (
        own.join(known, "control_url")
        .join(family, ["subfamily", "function_name"])
        .select(
            "control_url",
            "subfamily",
            "function_name",
            "n_sites",
            "n_pages",
            "n_sites_subfamily",
            "n_pages_subfamily",
            (F.col("n_sites") / F.col("n_sites_subfamily")).alias("sites_probability"),
            (F.col("n_pages") / F.col("n_pages_subfamily")).alias("pages_probability"),
        )
    )


def rarest_function(rows: DataFrame, probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """For rows with control_url and diff_functions: the least likely function and its probability.

    A function that the probabilities do not know counts as certain (1); rows without functions give none.
    """
    each = rows.select(*keys, *([] if "control_url" in keys else ["control_url"]), F.explode("diff_functions").alias("function_name"))
    known = probabilities.select("control_url", "function_name", F.col("sites_probability").alias("p"))
    each = each.join(known, ["control_url", "function_name"], "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    rarest = F.min(F.struct("p", "function_name"))
    return each.groupBy(*keys).agg(rarest.alias("r")).select(*keys, F.col("r.function_name").alias("rarest_function"), F.col("r.p").alias("rarest_probability"))


def controls_with_hits(controls: DataFrame, hits: DataFrame) -> DataFrame:
    """The controls that some hit names."""
    return controls.join(hits.select(F.col("control_url").alias("origin")), "origin", "left_semi")
