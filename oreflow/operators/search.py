"""Interactive searches over published hits: filters, orders and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 100
MAX_DISTANCE = 10_000


def validated(text: str | None = None, days: int | None = None, *distances: float) -> None:
    """ValueError for a blank text, less than one day, or a distance outside 0 to MAX_DISTANCE."""
    if text is not None and not text.strip():
        raise ValueError("a search text must not be blank")
    if days is not None and days < 1:
        raise ValueError("at least one day is needed")
    if any(not 0 <= d <= MAX_DISTANCE for d in distances):
        raise ValueError("a distance is out of range")


def by_host(hits: DataFrame, host: str, partial: bool = True, case_sensitive: bool = False) -> DataFrame:
    """Hits on a host, or on hosts that contain a text."""
    validated(host)
    c = F.col("cited_on_host")
    if not partial:
        return hits.where(c == host).orderBy(F.desc("function_dist"))
    return hits.where(c.contains(host) if case_sensitive else F.lower(c).contains(host.lower())).orderBy(F.desc("function_dist"))


def by_control(hits: DataFrame, control_url: str, partial: bool = True) -> DataFrame:
    validated(control_url)
    c = F.col("control_url")
    return hits.where(c.contains(control_url) if partial else c == control_url).orderBy("control_url", F.desc("function_dist"))


def by_distance(hits: DataFrame, ast: tuple = (0, None), function: tuple = (0, None), literal: tuple = (0, None)) -> DataFrame:
    """Hits in a box of distances, each [least, most); None: no bound."""
    out = hits
    for name, (low, high) in (("ast_dist", ast), ("function_dist", function), ("literal_dist", literal)):
        out = out.where(F.col(name) >= (low or 0))
        if high is not None:
            out = out.where(F.col(name) < high)
    return out


def recent(rows: DataFrame, days: int, created: str = "created_at", now: Column | None = None, exclude_hash_matches: bool = False, exclude_blank_functions: bool = False) -> DataFrame:
    """Rows created in the last days."""
    validated(None, days)
    now = F.current_timestamp() if now is None else now
    out = rows.where(F.col(created) >= now - F.make_interval(days=F.lit(days)))
    if exclude_hash_matches:
        out = out.where(~F.col("sha256_matched"))
    return out.where(F.size("diff_functions") > 0) if exclude_blank_functions else out


def by_function(hits: DataFrame, name: str) -> DataFrame:
    """Hits whose differing functions have a name."""
    validated(name)
    return hits.where(F.array_contains("diff_functions", name)).orderBy("cited_on_host", "ast_dist", "function_dist")


def page(rows: DataFrame, number: int, order: list, size: int = PAGE_SIZE) -> DataFrame:
    """One page of ordered rows, the first is 1; the order should be total."""
    if number < 1:
        raise ValueError("pages are counted from 1")
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def admin_list(rows: DataFrame, search: str | None, fields: list[str], order: list) -> DataFrame:
    """Rows of which some field contains the text in any case, in order."""
    if search:
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False))
        rows = rows.where(hit)
    return rows.orderBy(*order)
