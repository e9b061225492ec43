"""Reports over hits: columns control_url, origin_url, cited_on_host, cited_on_path, cited_on, xref, sha256_matched,
ast_dist, function_dist, literal_dist, diff_functions (array), diff_literals, n_diff_literals and literals_not_in_*.

Each report groups all controls at once; sets are sorted arrays, so results do not depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import suspicious_terms, total_length
from ..session import materialised
from .rarity import rarest_function


def distances(hits: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Per control, script and host: distances (the mean is that of the distinct ones), pages and differing functions.

    Distances and pages are counted by distinct aggregation; only the names of functions, a vocabulary,
    are gathered as a set.
    """
    near = hits.where((F.col("ast_dist") < threshold) & (F.col("function_dist") < threshold))
    return near.groupBy("control_url", "origin_url", "cited_on_host").agg(
        F.min("ast_dist").alias("min_distance"),
        F.expr("avg(DISTINCT ast_dist)").alias("avg_distance"),
        F.max("ast_dist").alias("max_distance"),
        F.min("function_dist").alias("min_function_dist"),
        F.countDistinct("cited_on_path").alias("n_pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("diff_functions")))).alias("diff_functions"),
    )


def unresolved_clusters(bad_hits: DataFrame, controls: DataFrame, min_sites: int = 15) -> DataFrame:
    """Scripts, by hash, that many sites use and that no control explains."""
    found = (
        bad_hits.where(F.col("sha256").isNotNull())
        .groupBy("sha256")
        .agg(F.countDistinct("origin_url").alias("n_js"), F.countDistinct("cited_on_host").alias("n_sites"), F.min("origin_url").alias("first_origin_url"))
        .where(F.col("n_sites") >= min_sites)
    )
    return found.join(controls.select("sha256").where("sha256 is not null"), "sha256", "left_anti").orderBy(F.desc("n_sites"), F.desc("n_js"), "sha256")


def _extremes(*names: str) -> list[Column]:
    return [f(c).alias(f"{p}_{c}") for c in names for p, f in (("min", F.min), ("max", F.max))]


def sites_by_control(hits: DataFrame, controls: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Per control: its size, on how many hosts it is found, and the range of its distances."""
    near = hits.where((F.col("ast_dist") < threshold) | (F.col("function_dist") < threshold))
    found = near.groupBy("control_url").agg(F.countDistinct("cited_on_host").alias("n_sites"), *_extremes("ast_dist", "function_dist", "literal_dist"))
    sizes = controls.select(F.col("origin").alias("control_url"), F.col("size_bytes").alias("control_bytes"))
    return found.join(sizes, "control_url", "left").orderBy(F.desc("n_sites"), "control_url", F.desc("max_ast_dist"))


def control_hits(hits: DataFrame, exclude_hash_matches: bool = False) -> DataFrame:
    """Per control and script: functions, hits, distances and literals; restrict hits to the controls of interest first.

    Rows are dealt by group at once: dealt by hit first, as a distinct count would, nearly all cross the network twice.
    The groups are written before they are sorted, as the sort reads its input twice.
    """
    rows = hits.where(~F.col("sha256_matched")) if exclude_hash_matches else hits
    keys, extremes = ["control_url", "origin_url"], ["ast_dist", "function_dist", "literal_dist"]
    largest = ["n_diff_literals", "literals_not_in_control", "literals_not_in_origin"]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        rows.select(*keys, "xref", "diff_functions", *extremes, *largest)
        .repartition(tasks, *keys)
        .groupBy(*keys)
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("diff_functions")))).alias("diff_functions"),
            F.countDistinct("xref").alias("n_hits"),
            *_extremes(*extremes),
            *(F.max(c).alias(f"max_{c}") for c in largest),
        )
    )
    return materialised(found, "control-hits").orderBy("min_ast_dist", "min_function_dist", "control_url", "origin_url")


def family_hits(hits: DataFrame, controls: DataFrame, family: str, exclude_hash_matches: bool = False) -> DataFrame:
    """control_hits of one family's controls."""
    chosen = controls.where(F.col("family") == family).select(F.col("origin").alias("control_url"))
    return control_hits(hits.join(chosen, "control_url", "left_semi"), exclude_hash_matches)


def subfamily_hits(hits: DataFrame, controls: DataFrame, pattern: str, exclude_hash_matches: bool = False) -> DataFrame:
    """control_hits of the controls whose subfamily matches a pattern, in any case."""
    chosen = controls.where(F.col("subfamily").rlike(f"(?i){pattern}")).select(F.col("origin").alias("control_url"))
    return control_hits(hits.join(chosen, "control_url", "left_semi"), exclude_hash_matches)


def list_controls(controls: DataFrame) -> DataFrame:
    """Per control the totals of its three count maps."""
    from ..functions.vector import map_total

    return controls.select(
        "origin",
        map_total(F.col("statements_by_count")).alias("sum_statements"),
        map_total(F.col("calls_by_count")).alias("sum_calls"),
        map_total(F.col("literals_by_count")).alias("sum_literals"),
    )


def with_distance_product(hits: DataFrame) -> DataFrame:
    return hits.withColumn("dist_prod", F.col("ast_dist") * F.col("function_dist"))


def hosts(hits: DataFrame, probabilities: DataFrame, threshold: float = 50.0, fold_terms: bool = False) -> DataFrame:
    """Per control and host: pages, differing literals and functions, suspicious terms and the rarest function.

    Each distinct text of literals is judged once and summed, so no group's texts are held together.
    """
    near = with_distance_product(hits).where(F.col("dist_prod") < threshold)
    keys = ["control_url", "cited_on_host"]
    found = near.groupBy(keys).agg(
        F.countDistinct("cited_on").alias("n_pages"),
        F.max("n_diff_literals").alias("max_diff_literals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("diff_functions")))).alias("diff_functions"),
    )
    one = F.array("diff_literals")
    judged = near.select(*keys, "diff_literals").distinct().select(*keys, suspicious_terms(one, fold_terms).alias("s"), total_length(one).alias("l"))
    literals = judged.groupBy(keys).agg(F.sum("s").alias("n_suspicious"), F.sum("l").alias("len_diff_literals"))
    found = found.select(*keys, "n_pages", "max_diff_literals", F.size("diff_functions").alias("n_diff_functions"), "diff_functions")
    rare = rarest_function(found.select(*keys, "diff_functions"), probabilities, keys)
    return found.join(literals, keys).join(rare, keys, "left").orderBy("cited_on_host", F.desc("max_diff_literals"), "control_url")


def host(hits: DataFrame, host_pattern: str, threshold: float = 50.0) -> DataFrame:
    """The best hit of each xref on hosts that match a pattern (only dots are literal), without hash matches."""
    pattern = host_pattern.replace(".", r"\.")
    near = with_distance_product(hits).where((F.col("dist_prod") < threshold) & ~F.col("sha256_matched") & F.col("cited_on_host").rlike(pattern))
    best = near.groupBy("xref").agg(F.min(F.struct("dist_prod", "control_url", "origin_url", "cited_on", "ast_dist", "function_dist", "literal_dist")).alias("hit"))
    return best.select("xref", "hit.*").orderBy("dist_prod", "xref")


def control_stats(hits: DataFrame, key: str = "control_url", least: int = 50) -> DataFrame:
    """Per control: hits, maxima and the spread of its distances, for controls with enough hits."""
    return (
        hits.groupBy(key)
        .agg(
            F.countDistinct("xref").alias("n"),
            F.max("ast_dist").alias("max_ast"),
            F.max("literal_dist").alias("max_literal"),
            F.max("n_diff_literals").alias("max_n_diff_literals"),
            F.stddev_samp("ast_dist").alias("stddev_ast"),
        )
        .where(F.col("n") >= least)
        .orderBy(F.desc("n"), F.desc("max_ast"), key)
    )


def pairwise(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """For rows of two tables with the same key: magnitudes, distances and differing features of their count maps."""
    from ..functions import vector as V

    a = left.select(key, *(F.col(c).alias(f"a_{c}") for c in ("statements_by_count", "calls_by_count", "literals_by_count")))
    b = right.select(key, *(F.col(c).alias(f"b_{c}") for c in ("statements_by_count", "calls_by_count", "literals_by_count")))
    both = a.join(b, key)
    s, c, x = ((F.col(f"a_{n}"), F.col(f"b_{n}")) for n in ("statements_by_count", "calls_by_count", "literals_by_count"))
    change = F.map_zip_with(*s, lambda k, p, q: F.abs(F.coalesce(p, F.lit(0)) - F.coalesce(q, F.lit(0))))
    ranked = F.array_sort(F.transform(F.filter(F.map_entries(change), lambda e: e["value"] > 0), lambda e: F.struct((-e["value"]).alias("change"), e["key"].alias("key"))))
    return both.select(
        key,
        V.map_total(s[0]).alias("a_magnitude"),
        V.map_total(s[1]).alias("b_magnitude"),
        V.vector_distance(V.ast_vector(s[0]), V.ast_vector(s[1])).alias("ast_dist"),
        F.transform(ranked, lambda e: e["key"]).alias("diff_features"),
        V.function_distance(*c).alias("function_dist"),
        V.differing_keys(*c).alias("diff_functions"),
        V.literal_distance(x[1], x[0])["dist"].alias("literal_dist"),
    )
