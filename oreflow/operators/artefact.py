"""The content-addressed store of artefacts, their links to urls, and their analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["sha256", "md5", "size_bytes"]


def with_hashes(rows: DataFrame, code_col: str = "code") -> DataFrame:
    """rows with sha256, md5 and size of their bytes."""
    data = F.col(code_col).cast("binary")
    return rows.withColumns({"sha256": F.sha2(data, 256), "md5": F.md5(data), "size_bytes": F.octet_length(data)})


def verified(rows: DataFrame, checksum_col: str = "checksum") -> tuple[DataFrame, DataFrame]:
    """(sound, damaged): rows whose declared checksum is, or is not, the md5 of their bytes."""
    fits = F.coalesce(F.col(checksum_col) == F.col("md5"), F.lit(False))
    return rows.where(fits), rows.where(~fits)


def content_id(key: list[str] = KEY) -> Column:
    """A stable 24-digit id of content."""
    return F.substring(F.sha2(F.concat_ws("\0", *(F.col(k).cast("string") for k in key)), 256), 1, 24)


def deduplicated(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with js_id and was_cached: whether the same content came earlier.

    The first arrival of each content is a map-side minimum; rows join it by the content key, so a
    content that a third of the rows share is split by adaptive execution rather than sorted in one task.
    """
    first = rows.groupBy(*KEY).agg(F.min(F.struct(*order)).alias("_first"))
    out = rows.join(first, KEY).withColumn("js_id", content_id())
    return out.withColumn("was_cached", F.struct(*order) != F.col("_first")).drop("_first")


def stored_scripts(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each content: js_id, its key, first arrival and number of arrivals."""
    return rows.groupBy(*KEY).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).select(content_id().alias("js_id"), *KEY, "first.*", "n")


def url_history(urls: DataFrame, links: DataFrame, scripts: DataFrame) -> DataFrame:
    """Each url's latest script: urls (url_id, url, last_visited), links (url_id, script), scripts (js_id, sha256)."""
    rows = urls.join(links, "url_id").join(scripts.select("js_id", "sha256"), F.col("script") == F.col("js_id"))
    latest = F.max(F.struct("last_visited", "url_id", "sha256"))
    return rows.groupBy("url").agg(latest.alias("x")).select("url", F.col("x.sha256").alias("sha256"), F.col("x.url_id").alias("url_id"))


def with_analysis(artefacts: DataFrame, analyses: DataFrame, analyse: Column) -> DataFrame:
    """artefacts with analysis: the stored one of their js_id, else what the expression computes."""
    stored = analyses.select("js_id", F.col("analysis").alias("_stored"))
    return artefacts.join(stored, "js_id", "left").withColumn("analysis", F.coalesce("_stored", analyse)).drop("_stored")


def not_analysed(artefacts: DataFrame, analyses: DataFrame) -> DataFrame:
    return artefacts.join(analyses.select("js_id"), "js_id", "left_anti")


def first_found(generations: list[DataFrame], key: str) -> DataFrame:
    """Rows of several generations of a table, each key from the first generation that has it."""
    rows = None
    for n, x in enumerate(generations):
        part = x.withColumn("generation", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "generation")]
    first = F.min(F.struct("generation", *rest))  # aggregates map-side, so no key is sorted in one task
    return rows.groupBy(key).agg(first.alias("_x")).select(*(F.col(c) if c == key else F.col(f"_x.{c}").alias(c) for c in rows.columns))


def feature_matrix(artefacts: DataFrame, names: list[str], counts_col: str = "statements_by_count", url_col: str = "url", order: str = "when") -> DataFrame:
    """Per content: rows, first url and one column for each feature."""
    rows = artefacts.groupBy("sha256").agg(F.count("*").alias("n"), F.min_by(url_col, order).alias("first_url"), F.min_by(counts_col, order).alias("_counts"))
    return rows.select("sha256", "n", "first_url", *(F.coalesce(F.element_at("_counts", F.lit(x)), F.lit(0)).alias(x) for x in names))


def keys(rows: DataFrame, counts_col: str) -> DataFrame:
    """The distinct keys of a map column."""
    return rows.select(F.explode(F.map_keys(counts_col)).alias("key")).distinct()


def document_frequency(rows: DataFrame, counts_col: str, least: int = 200, excluded: list[str] | None = None) -> DataFrame:
    """Keys of a map column that occur in at least so many rows, without the excluded ones."""
    found = rows.select(F.explode(F.map_keys(counts_col)).alias("key")).groupBy("key").agg(F.count("*").alias("n_rows"))
    return found.where((F.col("n_rows") >= least) & ~F.col("key").isin(excluded or [""]))


def accepted_controls(candidates: DataFrame, controls: DataFrame, least: int = 1000, force: bool = False) -> DataFrame:
    """New controls that are large enough and, unless forced, not stored yet."""
    rows = candidates.where(F.col("size_bytes") >= least)
    return rows if force else rows.join(controls.select("sha256"), "sha256", "left_anti")


def uploaded_controls(candidates: DataFrame, controls: DataFrame, analysis: Column, least: int = 1000, force: bool = False) -> dict[str, DataFrame]:
    """What an upload adds to each of its three tables: new controls, their code, and their totals.

    candidates: origin, family and code, such as a catalog's downloads; those that are too small, stored already
    (unless forced) or cannot be analysed are left out.
    """
    from ..functions.url import subfamily

    rows = accepted_controls(with_hashes(candidates), controls, least, force)
    rows = rows.withColumn("_a", analysis).where(~F.col("_a.failed"))
    vectors = [F.col(f"_a.{c}").alias(c) for c in ("statements_by_count", "calls_by_count", "literals_by_count")]
    known = [c for c in rows.columns if c not in ("code", "_a", "subfamily")]
    new = rows.select(*known, subfamily(F.col("origin")).alias("subfamily"), F.lit(False).alias("do_not_load"), *vectors)
    return {"javascript_controls": new, "javascript_control_code": rows.select("origin", "code", *vectors), "javascript_controls_summary": control_summary(new)}


def control_summary(controls: DataFrame, when: Column | None = None) -> DataFrame:
    """Totals of the three count maps of controls whose origin is a web address."""
    from ..functions import vector as V

    return controls.where(F.col("origin").startswith("http")).select(
        "origin",
        V.total(V.ast_vector(F.col("statements_by_count"))).cast("long").alias("sum_of_ast_features"),
        V.map_total(F.col("calls_by_count")).alias("sum_of_functions"),
        (when if when is not None else F.current_timestamp()).cast("string").alias("last_updated"),
        V.map_total(F.col("literals_by_count")).alias("sum_of_literals"),
    )


def inconsistent_vectors(stored: DataFrame, recomputed: DataFrame, key: str = "origin") -> DataFrame:
    """Keys whose stored and recomputed count maps differ."""
    from ..functions import vector as V

    names = ["statements_by_count", "calls_by_count", "literals_by_count"]
    a, b = stored.select(key, *(F.col(c).alias(f"a_{c}") for c in names)), recomputed.select(key, *(F.col(c).alias(f"b_{c}") for c in names))
    differs = F.lit(False)
    for c in names:
        differs = differs | (F.size(V.differing_keys(F.col(f"a_{c}"), F.col(f"b_{c}"))) > 0)
    return a.join(b, key).where(differs).select(key)
