"""Keeping tables up to date: upserts, refreshes, purges and corrections, as whole-table plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import subfamily
from . import artefact, match


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key of both; of equal order the largest row.  max_by aggregates map-side."""
    rows = table.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in key]
    latest = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    picked = rows.groupBy(*key).agg(latest.alias("_x"))
    return picked.select(*(F.col(c) if c in key else F.col(f"_x.{c}").alias(c) for c in rows.columns))


def refreshed(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """table with all rows of the keys in fresh replaced by those of fresh."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def purge(tables: dict[str, tuple[DataFrame, str]], purged: DataFrame, key: str = "origin", dry_run: bool = True) -> dict[str, DataFrame]:
    """For each table (and its column of keys): what would go if dry_run, else what stays."""
    out = {}
    for name, (rows, column) in tables.items():
        keys = purged.select(F.col(key).alias(column)).distinct()
        out[name] = rows.join(keys, column, "left_semi" if dry_run else "left_anti")
    return out


def without_control_hits(hits: DataFrame, control_url: str) -> DataFrame:
    return hits.where(~F.col("control_url").eqNullSafe(control_url))


def with_subfamilies(controls: DataFrame, only_changed: bool = False) -> DataFrame:
    """controls with their subfamily computed anew."""
    out = controls.withColumn("_new", subfamily(F.col("origin")))
    if only_changed:
        out = out.where(~F.col("subfamily").eqNullSafe(F.col("_new")))
    return out.withColumn("subfamily", F.col("_new")).drop("_new")


def recalculated(vetted: DataFrame, artefacts: DataFrame, controls: DataFrame, control_url: str, max_distance: float = 300.0) -> DataFrame:
    """The evaluation, anew, of the artefacts that were vetted against a control."""
    chosen = vetted.where(F.col("control_url") == control_url).select(F.col("origin_js_id").alias("js_id")).distinct()
    return match.evaluate(artefacts.join(chosen, "js_id", "left_semi"), controls, max_distance)


def corrected_hash_matches(hits: DataFrame, latest: DataFrame, controls: DataFrame) -> DataFrame:
    """hits with sha256_matched set where a hit at no distance has the hash of its control.

    latest: url and sha256 of each url's last script.
    """
    near = (F.col("ast_dist") < match.NEAR_ZERO) & (F.col("function_dist") < match.NEAR_ZERO)
    scripts = latest.select(F.col("url").alias("origin_url"), F.col("sha256").alias("_own"))
    known = controls.select(F.col("origin").alias("control_url"), F.col("sha256").alias("_control"))
    out = hits.join(scripts, "origin_url", "left").join(known, "control_url", "left")
    equal = F.coalesce(F.col("_own") == F.col("_control"), F.lit(False))
    return out.withColumn("sha256_matched", F.col("sha256_matched") | (near & equal)).drop("_own", "_control")


def recomputed(code: DataFrame, analysis: Column, when: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(fresh, summary) of stored control code (origin, code): hashes and size from its bytes, and the totals of its vectors.

    analysis gives a script's count maps, and failed for what cannot be analysed: such controls have hashes, no totals.
    """
    rows = artefact.with_hashes(code.where(F.col("origin").startswith("http")))
    vectors = ["statements_by_count", "calls_by_count", "literals_by_count"]
    made = rows.select("origin", analysis.alias("_a")).where(~F.col("_a.failed")).select("origin", *(F.col(f"_a.{c}").alias(c) for c in vectors))
    return rows.select("origin", *artefact.KEY), artefact.control_summary(made, when)
