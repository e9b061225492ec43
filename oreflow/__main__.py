"""The programs: python -m oreflow PROGRAM --help.

Tables are folders of Parquet below --warehouse, under the names of the pipeline's collections.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.javascript import analysed
from .functions.url import hostname
from .operators import artefact, crawl, maintenance, match, outlier, rarity, report, search
from .session import session, ship
from .sources import files, topics

REPORTS = ["unresolved_clusters", "sites_by_control", "distances", "subfamily_hits", "list_controls", "control_hits", "family_hits", "hosts", "host"]
SEARCHES = ["host", "control", "distance", "recent", "function"]

Run = Callable[[SparkSession, argparse.Namespace, Callable[[str], DataFrame]], DataFrame]


def run_report(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    hits, controls = (lambda: table("etl_hits")), (lambda: table("javascript_controls"))
    if a.query in ("subfamily_hits", "family_hits", "control_hits", "host") and not a.extra:
        raise SystemExit("this report needs --extra")
    return {
        "unresolved_clusters": lambda: report.unresolved_clusters(table("etl_bad_hits"), controls(), a.min_sites),
        "sites_by_control": lambda: report.sites_by_control(hits(), controls(), a.threshold),
        "distances": lambda: report.distances(hits(), a.threshold),
        "subfamily_hits": lambda: report.subfamily_hits(hits(), controls(), a.extra, a.exclude_hash_matches),
        "family_hits": lambda: report.family_hits(hits(), controls(), a.extra, a.exclude_hash_matches),
        "control_hits": lambda: report.control_hits(hits().where(F.col("control_url") == a.extra), a.exclude_hash_matches),
        "list_controls": lambda: report.list_controls(controls()),
        "hosts": lambda: report.hosts(hits(), table("function_probabilities"), a.threshold),
        "host": lambda: report.host(hits(), a.extra, a.threshold),
    }[a.query]()


def run_search(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    hits = table("etl_hits")
    if a.by == "distance":
        found = search.by_distance(hits, *((low, high) for low, high in zip(a.least or (0, 0, 0), a.most or (None, None, None))))
    elif a.by == "recent":
        found = search.recent(hits, a.days)
    else:
        found = {"host": search.by_host, "control": search.by_control, "function": search.by_function}[a.by](hits, a.text)
    return search.page(found, a.page, ["cited_on_host", "ast_dist", "function_dist", "xref"])


def run_features(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    new = artefact.not_analysed(table("scripts"), table("analysis_content")) if a.only_new else table("scripts")
    return new.select("js_id", "sha256", "md5", "size_bytes", analysed(F.col("code")).alias("a")).select("js_id", "sha256", "md5", "size_bytes", "a.*")


def run_evaluate(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    controls = match.load_controls(table("javascript_controls"), table("javascript_control_code"), a.min_size)
    return match.evaluate(table("analysis_results"), controls, a.max_distance, a.strategies.split(","))


def run_publish(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    good, bad = match.publish(table("vet_against_control"), table("javascript_controls"), a.threshold)
    return bad if a.bad else good


def run_probabilities(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    controls = rarity.controls_with_hits(table("javascript_controls"), table("etl_hits"))
    return rarity.function_probabilities(table("etl_hits"), controls, a.threshold)


def run_outliers(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    hits = outlier.selected(table("etl_hits"), table("javascript_controls"), a.control, a.family, a.subfamily)
    return outlier.outliers(outlier.matrix(hits, table("function_probabilities"), a.since))


def run_purge(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    purged = table("javascript_controls").where(a.where).select("origin")
    column = "origin" if a.table.startswith("javascript_control") else "control_url"
    return maintenance.purge({a.table: (table(a.table), column)}, purged, dry_run=not a.y)[a.table]


def run_subfamilies(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    controls = table("javascript_controls")
    return controls.select("origin", "subfamily") if a.list else maintenance.with_subfamilies(controls, a.dry_run)


def run_recalc(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return maintenance.recalculated(table("vet_against_control"), table("analysis_results"), table("javascript_controls"), a.control, a.max_distance)


def run_summary(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return artefact.control_summary(table("javascript_controls"))


def run_blacklist(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return crawl.host_page_counts(table("urls").withColumn("host", hostname(F.col("url"))), "host", a.threshold)


def run_retry(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return crawl.retry_candidates(table("javascript_download_failure"))


def run_stats(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return report.control_stats(table("etl_hits"), least=a.least)


def run_dump(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return topics.dump(table(a.topic), None if a.value_only else ["key", "timestamp"], a.n)


def run_seeds(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return topics.seed_urls(spark, a.file)


def run_pairwise(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    controls = table("javascript_controls")
    side = lambda origin: controls.where(F.col("origin") == origin).withColumn("pair", F.lit(1))
    return report.pairwise(side(a.left), side(a.right), "pair")


def run_artefact(spark: SparkSession, a: argparse.Namespace, table: Callable[[str], DataFrame]) -> DataFrame:
    return files.code_of(table("scripts"), a.js_id)


def parser() -> argparse.ArgumentParser:
    """All programs and their options."""
    top = argparse.ArgumentParser(prog="oreflow", description="Analytics of crawled artefacts")
    top.add_argument("--warehouse", required=True, help="folder of the tables")
    top.add_argument("--out", help="folder of the result; without, some rows are shown")
    top.add_argument("--format", choices=["tsv", "parquet", "json"], default="tsv")
    top.add_argument("--rows", type=int, default=100, help="rows to show without --out")
    programs = top.add_subparsers(dest="program", required=True)

    def program(name: str, run: Run, *options: tuple) -> None:
        p = programs.add_parser(name)
        p.set_defaults(run=run)
        for flag, more in options:
            p.add_argument(flag, **more)

    number = lambda default: {"type": float, "default": default}
    program("report", run_report, ("--query", {"choices": REPORTS, "required": True}), ("--extra", {}), ("--threshold", number(100.0)), ("--min-sites", {"type": int, "default": 15}), ("--exclude-hash-matches", {"action": "store_true"}))
    program("search", run_search, ("--by", {"choices": SEARCHES, "required": True}), ("--text", {}), ("--days", {"type": int, "default": 7}), ("--least", {"type": float, "nargs": 3}), ("--most", {"type": float, "nargs": 3}), ("--page", {"type": int, "default": 1}))
    program("features", run_features, ("--only-new", {"action": "store_true"}))
    program("evaluate", run_evaluate, ("--max-distance", number(300.0)), ("--min-size", {"type": int, "default": 1500}), ("--strategies", {"default": "ast,calls"}))
    program("publish", run_publish, ("--threshold", number(300.0)), ("--bad", {"action": "store_true"}))
    program("probabilities", run_probabilities, ("--threshold", number(100.0)))
    program("outliers", run_outliers, ("--since", {}), ("--control", {}), ("--family", {}), ("--subfamily", {}))
    program("purge", run_purge, ("--where", {"required": True, "help": "condition on controls"}), ("--table", {"required": True}), ("--y", {"action": "store_true"}))
    program("subfamilies", run_subfamilies, ("--list", {"action": "store_true"}), ("--dry-run", {"action": "store_true"}))
    program("recalc", run_recalc, ("--control", {"required": True}), ("--max-distance", number(300.0)))
    program("summary", run_summary)
    program("blacklist", run_blacklist, ("--threshold", {"type": int, "default": 80}))
    program("retry", run_retry)
    program("stats", run_stats, ("--least", {"type": int, "default": 50}))
    program("dump", run_dump, ("--topic", {"required": True}), ("--n", {"type": int}), ("--value-only", {"action": "store_true"}))
    program("seeds", run_seeds, ("--file", {"required": True}))
    program("pairwise", run_pairwise, ("--left", {"required": True}), ("--right", {"required": True}))
    program("artefact", run_artefact, ("--js-id", {"required": True}))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(arguments)
    spark = spark or session()
    ship(spark)
    store = files.StoreOptions(a.warehouse)
    rows = a.run(spark, a, lambda name: spark.read.parquet(store.table(name)))
    if not a.out:
        rows.show(a.rows, truncate=False)
    elif a.format == "tsv":
        files.write_tsv(rows, a.out)
    else:
        rows.write.mode("overwrite").format(a.format).save(a.out)
    return rows


if __name__ == "__main__":
    main()
