"""Crawl decisions: which urls to fetch, what a page offers, how hosts are penalised and cached."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, url

#: Pages of a host after which it counts as crawled.
MAX_PAGES_PER_SITE = 20
PER_HOST_AND_BATCH = 10
MAX_PRIORITY = 4
OVER_REPRESENTED = 80

#: A criterion: its name, and the condition under which a url is rejected.
Criterion = tuple[str, Column]


def standard_criteria() -> list[Criterion]:
    """The criteria of a full crawl over rows with flags and counts, in the order in which they are asked."""
    return [
        ("blacklisted", F.col("is_blacklisted")),
        ("recently_crawled", F.col("n_recent") > MAX_PAGES_PER_SITE),
        ("in_recent_sites", F.col("n_site_cache") > MAX_PAGES_PER_SITE),
        ("congested_batch", F.col("rank_in_batch") > PER_HOST_AND_BATCH),
        ("long_term_banned", F.col("is_banned")),
        ("unsuitable_priority", F.col("priority") > MAX_PRIORITY),
        ("outside_au", F.col("is_outside")),
    ]


def snippet_criteria() -> list[Criterion]:
    """The criteria of a crawl for inline scripts."""
    return [x for x in standard_criteria() if x[0] in ("blacklisted", "long_term_banned")]


def with_dimensions(
    urls: DataFrame,
    blacklisted: DataFrame | None = None,
    banned: DataFrame | None = None,
    recent: DataFrame | None = None,
    countries: DataFrame | None = None,
    url_col: str = "url",
    home: str = "AU",
    home_suffix: str = ".au",
) -> DataFrame:
    """urls with host and what the standard criteria need: is_blacklisted, is_banned, n_site_cache and is_outside.

    blacklisted and banned hold hosts, recent holds host and n, countries holds host and country.  Small ones are
    broadcast by the optimiser, large ones joined by host.  A host with the home suffix counts as inside without
    a lookup; one whose country is unknown counts as outside.
    """
    out = urls.withColumn("host", url.hostname(F.col(url_col)))
    for name, listed in (("is_blacklisted", blacklisted), ("is_banned", banned)):
        if listed is None:
            out = out.withColumn(name, F.lit(False))
            continue
        hosts = listed.select(F.col(listed.columns[0]).alias("host")).distinct().withColumn("_in", F.lit(True))
        out = out.join(hosts, "host", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")
    if recent is not None:
        out = out.join(recent.groupBy("host").agg(F.max("n").alias("n_site_cache")), "host", "left")
    out = out.withColumn("n_site_cache", F.coalesce("n_site_cache", F.lit(0)) if recent is not None else F.lit(0))
    inside = F.col("host").endswith(home_suffix)
    if countries is not None:
        out = out.join(countries.groupBy("host").agg(F.max(F.col("country") == home).alias("_home")), "host", "left")
        inside = inside | F.coalesce("_home", F.lit(False))
    return out.withColumn("is_outside", ~F.coalesce(inside, F.lit(False))).drop("_home")


def uploadable(downloads: DataFrame, host: str) -> DataFrame:
    """The downloads of one crawler's host that know the page they were found on."""
    return downloads.where((F.col("host") == host) & F.col("origin").isNotNull())


def suitability(urls: DataFrame, criteria: Sequence[Criterion], url_col: str = "url") -> DataFrame:
    """urls with host and reject_reason: the first that applies, null for suitable ones.

    Scheme, url seen before (n_seen > 0, if there is that column) and host come before the criteria.
    """
    u = F.col(url_col)
    rows = urls.withColumn("host", url.hostname(u)) if "host" not in urls.columns else urls
    reason = F.when(~url.scheme(u).isin("http", "https"), "bad_scheme")
    if "n_seen" in urls.columns:
        reason = reason.when(F.col("n_seen") > 0, "recently_seen")
    reason = reason.when(F.col("host").isNull(), "no_host")
    for name, rejects in criteria:
        reason = reason.when(F.coalesce(rejects, F.lit(False)), name)
    return rows.withColumn("reject_reason", reason)


def reject_counts(judged: DataFrame) -> DataFrame:
    """How many urls each reason rejects; null: suitable."""
    return judged.groupBy("reject_reason").agg(F.count("*").alias("n"))


def without_listed(urls: DataFrame, listed: DataFrame, host_col: str = "host") -> DataFrame:
    """The urls whose host is not in a list of hosts."""
    return urls.join(listed.select(F.col(listed.columns[0]).alias(host_col)), host_col, "left_anti")


def congested(batches: DataFrame, batch: str, host: str, order: Sequence[str], per_host: int = PER_HOST_AND_BATCH) -> DataFrame:
    """The first so many urls of each host in each batch; urls without host never pass."""
    w = Window.partitionBy(batch, host).orderBy(*order)
    return batches.where(F.col(host).isNotNull()).withColumn("rank_in_batch", F.row_number().over(w)).where(F.col("rank_in_batch") <= per_host)


def running_pages(visits: DataFrame, host: str, order: Sequence[str], penalty: Column | int = 1, chunk: Column | None = None) -> DataFrame:
    """visits with n_recent: the penalties of the host's earlier visits.

    chunk, a coarse value that never falls along the order (such as the day of a time), lets a busy
    host be sorted chunk by chunk in many tasks; the chunks' totals are summed up beforehand.
    """
    cost = F.lit(penalty) if isinstance(penalty, int) else penalty
    rows = visits.withColumns({"_chunk": F.lit(0) if chunk is None else chunk, "_cost": cost})
    inside = Window.partitionBy(host, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_cost").over(inside), F.lit(0)))
    if chunk is None:
        return rows.withColumnRenamed("_own", "n_recent").drop("_chunk", "_cost")
    totals = visits.withColumns({"_chunk": chunk, "_cost": cost}).groupBy(host, "_chunk").agg(F.sum("_cost").alias("_total"))
    earlier = Window.partitionBy(host).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col(host).alias("_host"), F.col("_chunk").alias("_at"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    same = F.col(host).eqNullSafe(F.col("_host")) & F.col("_chunk").eqNullSafe(F.col("_at"))
    out = rows.join(before, same).withColumn("n_recent", F.col("_own") + F.col("_before"))
    return out.drop("_chunk", "_cost", "_own", "_host", "_at", "_before")


def page_penalty(status: Column, content_type: Column) -> Column:
    """What a visit adds to its host's count: 1 for a page, 2 for a failure or other content."""
    return F.when((status == 200) & content_type.contains("html"), 1).otherwise(2)


def host_page_counts(pages: DataFrame, host: str, threshold: int = OVER_REPRESENTED) -> DataFrame:
    """Hosts with more pages than threshold."""
    return pages.groupBy(host).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") > threshold)


def over_represented(counts: DataFrame, host: str = "host", n: str = "n_pages", order: str | None = None, least: int = OVER_REPRESENTED) -> DataFrame:
    """Per host the largest count of at least `least`; with order, the latest such count instead."""
    value = F.max(n) if order is None else F.max_by(n, order)
    return counts.where(F.col(n) >= least).groupBy(host).agg(value.alias("n_pages"))


def recent_sites(*caches: DataFrame, host: str = "host", n: str = "n") -> DataFrame:
    """Caches of page counts merged, the largest count of each host."""
    rows = caches[0].select(host, n)
    for x in caches[1:]:
        rows = rows.unionByName(x.select(host, n))
    return rows.groupBy(host).agg(F.max(n).alias(n))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with host, n_hrefs, external and internal.

    n_hrefs counts all links, repeats too.  external and internal are the distinct absolute links, with their
    fragments, whose text does not, or does, contain the page's host.  Each page stays one row, in place.
    """
    links = url.absolutes(F.col(url_col), text.hrefs(F.col(html_col)))
    found = pages.withColumns({"host": url.hostname(F.col(url_col)), "_links": links})
    inside = lambda x: F.coalesce(x.contains(F.col("host")), F.lit(False))
    distinct = F.array_sort(F.array_distinct("_links"))
    found = found.withColumns({
        "n_hrefs": F.coalesce(F.size("_links"), F.lit(0)),
        "external": F.coalesce(F.filter(distinct, lambda x: ~inside(x)), F.array().cast("array<string>")),
        "internal": F.coalesce(F.filter(distinct, inside), F.array().cast("array<string>")),
    })
    return found.drop("_links", html_col)


def may_follow(link: Column) -> Column:
    """Whether a link is a web address with a host."""
    return url.scheme(link).isin("http", "https") & url.hostname(link).isNotNull()


def page_stats(
    linked: DataFrame, n_seen: Column | int = 0, max_internal: int = 20, suitable: Callable[[Column], Column] = may_follow, overrun: int = 1
) -> DataFrame:
    """Numbers of links, of those permitted and accepted: external ones first, then internal ones of hosts seen seldom.

    suitable says of a link whether the crawl's criteria let it pass; it is asked for every link.  n_seen counts the
    host's pages with this one.  A run of links stops behind the one that exceeds its limit, so `overrun` more go out.
    """
    seen = F.lit(n_seen) if isinstance(n_seen, int) else n_seen
    permitted = F.lit(100) - 4 * F.least(seen, F.lit(MAX_PAGES_PER_SITE))
    fits = lambda c: F.size(F.filter(c, lambda x: F.coalesce(suitable(x), F.lit(False))))
    accepted = F.least(fits("external"), permitted + overrun)
    room = F.least(F.greatest(permitted - accepted, F.lit(0)), F.lit(max_internal))
    return linked.withColumns({
        "n_hrefs_max_permitted": permitted,
        "n_external": F.size("external"),
        "n_external_accepted": accepted,
        "n_internal": F.size("internal"),
        "n_internal_accepted": F.when(seen < max_internal, F.least(fits("internal"), room + overrun)).otherwise(0),
    })


def page_scripts(pages: DataFrame, url_col: str = "url", html_col: str = "html", fetched: DataFrame | None = None) -> DataFrame:
    """pages with scripts (all script urls, blank-separated), n_scripts, and n_scripts_accepted: new web addresses among them.

    fetched: urls of scripts that were fetched lately; each is asked for once.
    """
    sources = url.absolutes(F.col(url_col), text.script_sources(F.col(html_col)))
    rows = pages.withColumn("_sources", F.coalesce(sources, F.array().cast("array<string>")))
    fits = F.filter(F.array_distinct("_sources"), may_follow)
    out = rows.withColumns({"scripts": F.array_join("_sources", " "), "n_scripts": F.size("_sources"), "n_scripts_accepted": F.size(fits)})
    if fetched is not None:
        known = fetched.select(F.col(fetched.columns[0]).alias("_script")).distinct()
        # a url may have several pages, so it does not tell whose scripts are counted
        key = F.sha2(F.to_json(F.struct(F.col(url_col).alias("url"), F.col("_sources").alias("sources"))), 256).alias("_key")
        each = rows.select(key, F.explode(fits).alias("_script")).distinct().join(known, "_script").groupBy("_key").agg(F.count("*").cast("int").alias("_known"))
        out = out.withColumn("_key", key).join(each, "_key", "left").withColumn("n_scripts_accepted", F.col("n_scripts_accepted") - F.coalesce("_known", F.lit(0))).drop("_known", "_key")
    return out.drop("_sources")


def sampled_links(links: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """At most so many links of each key, chosen by a seeded hash, so that repeated runs agree."""
    w = Window.partitionBy(key).orderBy(F.xxhash64("link", F.lit(seed)), "link")
    return links.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def inline_scripts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url, position, code, sha256, md5 and size of each script inside a page."""
    rows = pages.select(F.col(url_col).alias("url"), F.posexplode(text.inline_scripts(F.col(html_col))).alias("position", "code"))
    code = F.col("code").cast("binary")
    return rows.withColumns({"sha256": F.sha2(code, 256), "md5": F.md5(code), "size_bytes": F.octet_length("code")})


def foreign_scripts(pages: DataFrame, url_col: str = "url", scripts_col: str = "scripts", suffixes: tuple[str, ...] = (".com", ".au", ".net", ".org")) -> DataFrame:
    """url, script and host of scripts from a host that is neither the page's nor under a usual suffix."""
    rows = pages.select(F.col(url_col).alias("url"), url.hostname(F.col(url_col)).alias("page_host"), F.explode(text.words(F.col(scripts_col))).alias("script"))
    rows = rows.withColumn("host", url.hostname(F.col("script")))
    return rows.where(url.is_foreign(F.col("host"), suffixes) & (F.col("host") != F.col("page_host"))).drop("page_host")


def retry_candidates(failures: DataFrame, status_col: str = "http_status", url_col: str = "url") -> DataFrame:
    """Failed urls worth another try, each once: refused (403; also failures without status) and server errors."""
    status = F.coalesce(F.col(status_col), F.lit(403))
    return failures.where(((status == 403) | (status >= 500)) & F.col(url_col).isNotNull()).select(url_col).distinct()


def failures_of_host(failures: DataFrame, host: str, urls_col: str = "file_urls") -> DataFrame:
    """Failures whose first url is on a host."""
    return failures.where(url.hostname(F.try_element_at(F.col(urls_col), F.lit(1))) == host)


def reprioritised(urls: DataFrame, dropped_host: str, max_priority: int = MAX_PRIORITY, max_length: int = 200, url_col: str = "url") -> DataFrame:
    """Distinct short urls outside a host, of good priority."""
    u = F.col(url_col)
    return urls.select(url_col).distinct().where((F.length(u) <= max_length) & ~F.coalesce(url.hostname(u).contains(dropped_host), F.lit(False)) & (url.priority(u) <= max_priority))


def routed(fetched: DataFrame, status_col: str = "status", error_col: str = "error") -> DataFrame:
    """fetched with route: canonical for 2xx and 3xx, failed for other states, exception without any."""
    status = F.col(status_col)
    return fetched.withColumn("route", F.when(F.col(error_col).isNotNull() | status.isNull(), "exception").when(status.between(200, 399), "canonical").otherwise("failed"))


def geolocated(hosts: DataFrame, ranges: DataFrame, host_col: str = "host") -> DataFrame:
    """hosts that are IPv4 addresses with the country of their range (start, stop inclusive, country).

    Ranges are cut at /8 borders, so an address meets only the ranges of its own /8 block.
    """
    block = lambda c: F.shiftright(c, 24)
    cut = ranges.select("start", "stop", "country", F.explode(F.sequence(block(F.col("start")), block(F.col("stop")))).alias("block"))
    rows = hosts.withColumn("ip", url.ip_number(F.col(host_col))).withColumn("block", block(F.col("ip")))
    joined = rows.join(cut, "block").where(F.col("ip").between(F.col("start"), F.col("stop")))
    return joined.groupBy(*hosts.columns, "ip").agg(F.min("country").alias("country"))
