"""More registered queries: crawling with dimension tables, sources, sinks, upkeep and the daemons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text, url
from ..functions import vector as V
from ..functions.javascript import analysed, unpacked
from ..operators import artefact, crawl, maintenance, match, outlier, rarity, search
from ..session import materialised, new_path, spread
from ..sources import files, topics
from ..streaming import pipelines, programs
from .analogue import HITS_SQL, controls, hits, table
from .registry import query
from .streams import collected

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


# --- crawl -----------------------------------------------------------------------------------

# Links of the pages are all local.  Here those that begin with t lead elsewhere, those with a to a busy host,
# those with c into the page itself, and every link occurs twice.
_LINKED = r"""p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
  replace(replace(replace(html || html, 'href="/t', 'href="https://other.example/t'), 'href="/a', 'href="https://busy.example/a'), 'href="/c', 'href="#c') AS html, page_id % 30 AS seen FROM pages),
h AS (SELECT *, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM p),
l AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN scheme || '://' || host || href WHEN starts_with(href, '#') THEN url || href ELSE href END AS link FROM h),
n AS (SELECT p.page_id, p.seen, p.host, count(link) AS n_hrefs, count(DISTINCT link) FILTER (WHERE NOT contains(link, p.host)) AS n_external, count(DISTINCT link) FILTER (WHERE contains(link, p.host)) AS n_internal,
  count(DISTINCT link) FILTER (WHERE NOT contains(link, p.host) AND NOT starts_with(link, 'https://busy.example/')) AS fit_external FROM p LEFT JOIN l USING (page_id) GROUP BY 1, 2, 3),
s AS (SELECT *, 100 - 4 * least(seen, 20) AS permitted FROM n),
e AS (SELECT *, least(fit_external, permitted + 1) AS n_external_accepted FROM s)"""


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat("html", "html")
    for old, new in (('href="/t', 'href="https://other.example/t'), ('href="/a', 'href="https://busy.example/a'), ('href="/c', 'href="#c')):
        html = F.replace(html, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "pages").withColumn("html", html)


@query(f"""WITH {_LINKED} SELECT page_id, n_hrefs, permitted AS n_hrefs_max_permitted, n_external, n_external_accepted, n_internal,
CASE WHEN seen < 20 THEN least(n_internal, least(greatest(permitted - n_external_accepted, 0), 20) + 1) ELSE 0 END AS n_internal_accepted FROM e""")
def q_page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    suitable = lambda x: crawl.may_follow(x) & (url.hostname(x) != "busy.example")
    out = crawl.page_stats(crawl.page_links(_linked_pages(spark, sf_dir)), F.col("page_id") % 30, suitable=suitable)
    return out.select("page_id", *(F.col(c).cast("long").alias(c) for c in ("n_hrefs", "n_hrefs_max_permitted", "n_external", "n_external_accepted", "n_internal", "n_internal_accepted")))


@query(r"""WITH p AS (SELECT url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, replace(replace(html, '<a href=', '<script src='), 'src="/t', 'src="data:t') AS html FROM pages),
l AS (SELECT url, list_transform(regexp_extract_all(html, '(?i)<script\s[^>]*?src=["'']([^"'']*)["'']', 1), lambda s: CASE WHEN starts_with(s, '/') THEN scheme || '://' || host || s ELSE s END) AS l FROM p)
SELECT url, array_to_string(l, ' ') AS scripts, len(l)::INT AS n_scripts, len(list_filter(list_distinct(l), lambda s: NOT starts_with(s, 'data:') AND NOT contains(s, '/M')))::INT AS n_scripts_accepted FROM l""")
def q_page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.replace(F.replace("html", F.lit("<a href="), F.lit("<script src=")), F.lit('src="/t'), F.lit('src="data:t'))
    pages = table(spark, sf_dir, "pages").select("url", html.alias("html"))
    links = url.absolutes(F.col("url"), text.script_sources(F.col("html")))
    fetched = pages.select(F.explode(F.filter(links, lambda x: x.contains("/M"))).alias("script"))
    return crawl.page_scripts(pages, fetched=fetched).select("url", "scripts", "n_scripts", "n_scripts_accepted")


_DIMENSIONS = f"""h AS (SELECT page_id, url, {_HOST} AS host FROM pages), k AS (SELECT h.*, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS n_recent, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rk FROM h),
cache AS (SELECT host, count(*) AS n FROM h GROUP BY host), known AS (SELECT DISTINCT host, CASE WHEN host LIKE '%.org' THEN 'AU' ELSE 'NZ' END AS country FROM h WHERE NOT host LIKE '%.com')"""


@query(f"""WITH {_DIMENSIONS} SELECT page_id, CASE WHEN starts_with(host, 'm.') THEN 'blacklisted' WHEN n_recent > 20 THEN 'recently_crawled' WHEN n > 20 THEN 'in_recent_sites' WHEN rk > 10 THEN 'congested_batch'
WHEN starts_with(host, 'blog.') THEN 'long_term_banned' WHEN NOT (host LIKE '%.net' OR coalesce(country, '') = 'AU') THEN 'outside_au' END AS reject_reason FROM k LEFT JOIN cache USING (host) LEFT JOIN known USING (host)""")
def q_crawl_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criteria over lists and tables of hosts, each joined; .net plays the suffix of home."""
    from pyspark.sql import Window

    pages = table(spark, sf_dir, "pages").select("page_id", "url", url.hostname(F.col("url")).alias("host"))
    each = pages.groupBy("host").agg(F.count("*").alias("n"))
    country = F.when(F.col("host").endswith(".org"), "AU").otherwise("NZ").alias("country")
    named = lambda prefix: each.where(F.col("host").startswith(prefix)).select("host")
    rows = crawl.with_dimensions(pages, named("m."), named("blog."), each, each.where(~F.col("host").endswith(".com")).select("host", country), home_suffix=".net")
    rank = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    rows = rows.withColumns({"rank_in_batch": rank, "n_recent": rank - 1, "priority": F.lit(1)})
    return crawl.suitability(rows, crawl.standard_criteria()).select("page_id", "reject_reason")


@query(f"""WITH {_DIMENSIONS} SELECT page_id, CASE WHEN starts_with(host, 'm.') THEN 'blacklisted' WHEN starts_with(host, 'blog.') THEN 'long_term_banned' END AS reject_reason FROM h""")
def q_snippet_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(url.hostname(F.col("url")).alias("host")).distinct()
    rows = crawl.with_dimensions(pages, hosts.where("host like 'm.%'"), hosts.where("host like 'blog.%'"))
    return crawl.suitability(rows, crawl.snippet_criteria()).select("page_id", "reject_reason")


@query(f"SELECT page_id FROM pages WHERE NOT {_HOST} IN (SELECT DISTINCT {_HOST} FROM pages WHERE page_id % 5 = 0)")
def q_without_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", url.hostname(F.col("url")).alias("host"))
    return crawl.without_listed(pages, pages.where("page_id % 5 = 0").select("host").distinct()).select("page_id")


@query(f"""SELECT DISTINCT url FROM pages WHERE length(url) <= 45 AND NOT contains({_HOST}, 'blog') AND url IN (SELECT url FROM pages WHERE
1 + least(length(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]', '', 'g')), 3) + CASE WHEN length(regexp_extract(url, '\\?([^#]*)', 1)) >= 20 THEN 2 WHEN length(regexp_extract(url, '\\?([^#]*)', 1)) > 0 THEN 1 ELSE 0 END <= 3)""")
def q_reprioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.reprioritised(table(spark, sf_dir, "pages"), "blog", 3, 45)


@query("SELECT event_id FROM events WHERE event_type = 'error' AND user_id = 3")
def q_failures_of_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(F.lit("https://U"), "user_id", F.lit(".example/"), "event_id")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.array(address, F.lit("https://u3.example/")).alias("file_urls"))
    return crawl.failures_of_host(rows, "u3.example").select("event_id")


@query("SELECT event_id FROM events WHERE user_id % 3 = 1 AND event_type <> 'view'")
def q_upload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("crawler"), F.col("user_id") % 3).alias("host"), F.when(F.col("event_type") != "view", "https://page.example/").alias("origin"))
    return crawl.uploadable(rows, "crawler1").select("event_id")


@query("SELECT user_id, least(count(*), 5) AS n, count(*) AS n_all FROM events GROUP BY user_id")
def q_sampled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links of each key a sample has; which ones depends on a hash."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("link"))
    some = crawl.sampled_links(rows, "user_id", 5).groupBy("user_id").agg(F.countDistinct("link").alias("n"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n_all")).join(some, "user_id").select("user_id", "n", "n_all")


@query("""SELECT event_id, user_id % 4 = 0 AS ip, CASE WHEN user_id % 4 = 0 THEN 10 * 16777216 + (event_id // 65536 % 256) * 65536 + (event_id // 256 % 256) * 256 + event_id % 256 END AS number, user_id % 4 IN (0, 1) AS any_ip FROM events""")
def q_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    four = F.concat_ws(".", F.lit("10"), *((F.floor(e / 256**n) % 256).cast("string") for n in (2, 1, 0)))
    kind = F.col("user_id") % 4
    host = F.when(kind == 0, four).when(kind == 1, F.concat(F.lit("2001:db8::"), F.hex(e % 65536))).when(kind == 2, F.concat(F.lit("300."), four)).otherwise("name.example")
    rows = table(spark, sf_dir, "events").withColumn("host", host)
    return rows.select("event_id", url.ip_number(F.col("host")).isNotNull().alias("ip"), url.ip_number(F.col("host")).alias("number"), url.is_ip(F.col("host")).alias("any_ip"))


# --- hits and upkeep -------------------------------------------------------------------------


@query(f"""WITH {HITS_SQL}, latest AS (SELECT origin_url, sha256(max(xref)) AS sha256 FROM hits WHERE NOT contains(origin_url, '/3.js') GROUP BY 1)
SELECT xref, h.control_url, h.origin_url, sha256, 's' || regexp_extract(h.cited_on, 's(\\d+)', 1) || '.example' AS cited_on_host, ast_dist FROM hits h LEFT JOIN latest USING (origin_url) WHERE ast_dist > 45""")
def q_poor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).drop("cited_on_host", "cited_on_path")
    latest = rows.where(~F.col("origin_url").contains("/3.js")).groupBy("origin_url").agg(F.sha2(F.max("xref"), 256).alias("sha256"))
    return match.poor_hits(rows, latest.withColumnRenamed("origin_url", "url"), 45.0).select("xref", "control_url", "origin_url", "sha256", "cited_on_host", "ast_dist")


@query(f"""WITH {HITS_SQL} SELECT xref, control_url, origin_url, ast_dist, function_dist, sha256_matched OR (ast_dist - 1 < 1e-5 AND function_dist < 1e-5 AND regexp_extract(origin_url, '(\\d)\\.js', 1)::INT = regexp_extract(control_url, '(\\d+)$', 1)::INT % 5) AS sha256_matched FROM hits""")
def q_corrected_hash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    latest = rows.select(F.col("origin_url").alias("url"), F.regexp_extract("origin_url", r"(\d)\.js", 1).alias("sha256")).distinct()
    known = controls(spark, sf_dir).select("origin", (F.regexp_extract("origin", r"(\d+)$", 1).cast("int") % 5).cast("string").alias("sha256"))
    out = maintenance.corrected_hash_matches(rows.withColumn("ast_dist", F.col("ast_dist") - 1), latest, known)
    return out.select("xref", "control_url", "origin_url", (F.col("ast_dist") + 1).alias("ast_dist"), "function_dist", "sha256_matched")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'stored ' || p_brand ELSE 'made ' || p_name END AS analysis FROM part")
def q_with_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("js_id"), "p_name", "p_brand")
    stored = rows.where("p_partkey % 3 = 0").select("js_id", F.concat(F.lit("stored "), "p_brand").alias("analysis"))
    return artefact.with_analysis(rows, stored, F.concat(F.lit("made "), F.col("p_name"))).select("p_partkey", "analysis")


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def q_not_analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("js_id"))
    return artefact.not_analysed(rows, rows.where("p_partkey % 3 = 0").select("js_id")).select("p_partkey")


@query("SELECT 'https://controls.example/' || p_partkey AS origin FROM part WHERE p_size * 100 >= 1500 AND p_size <> 1 AND p_partkey % 4 <> 0")
def q_load_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = controls(spark, sf_dir)
    code = rows.where(F.regexp_extract("origin", r"(\d+)$", 1).cast("int") % 4 != 0).select("origin")
    return match.load_controls(rows, code, 1500).select("origin")


@query("SELECT 'https://controls.example/' || p_partkey AS origin FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def q_controls_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity.controls_with_hits(controls(spark, sf_dir), hits(spark, sf_dir)).select("origin")


@query("SELECT 'https://controls.example/' || p_partkey AS origin FROM part WHERE p_partkey % 7 = 0 AND p_size > 1")
def q_inconsistent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("https://controls.example/"), "p_partkey").alias("origin")
    one = lambda n: F.create_map(F.col("p_brand"), n)
    maps = lambda n: [one(F.lit(1)).alias("statements_by_count"), one(n).alias("calls_by_count"), one(F.lit(2)).alias("literals_by_count")]
    rows = table(spark, sf_dir, "part")
    changed = F.when(F.col("p_partkey") % 7 == 0, F.lit(1)).otherwise(F.col("p_size").cast("int"))
    return artefact.inconsistent_vectors(rows.select(key, *maps(F.col("p_size").cast("int"))), rows.select(key, *maps(changed)))


@query("""SELECT 'https://controls.example/' || p_partkey AS origin, sha256('go' || p_size || '("' || p_type || '");') AS sha256, md5('go' || p_size || '("' || p_type || '");') AS md5,
length('go' || p_size || '("' || p_type || '");')::INT AS size_bytes, 1::BIGINT AS sum_of_functions, 1::BIGINT AS sum_of_literals FROM part""")
def q_rehashed_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("go"), "p_size", F.lit('("'), "p_type", F.lit('");')).cast("binary")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("https://controls.example/"), "p_partkey").alias("origin"), code.alias("code"))
    fresh, summary = maintenance.recomputed(rows, analysed(F.col("code")))
    return fresh.join(summary, "origin").select("origin", "sha256", "md5", "size_bytes", "sum_of_functions", "sum_of_literals")


@query(f"""WITH {HITS_SQL} SELECT control_url, count(*) AS n FROM hits JOIN controls ON control_url = origin WHERE contains(controls.family, '1') AND regexp_matches(controls.subfamily, 'PROMO|STEEL') GROUP BY 1""")
def q_outlier_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = outlier.selected(hits(spark, sf_dir), controls(spark, sf_dir), family="1", subfamily="PROMO|STEEL")
    return chosen.groupBy("control_url").agg(F.count("*").alias("n"))


@query("""SELECT origin, sum_ast, sum_functions FROM (SELECT 'https://controls.example/' || p_partkey AS origin, p_size AS sum_ast, length(p_name) AS sum_functions FROM part) ORDER BY sum_ast, sum_functions, origin LIMIT 100""")
def q_summary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("https://controls.example/"), "p_partkey").alias("origin"), F.col("p_size").alias("sum_ast"), F.length("p_name").alias("sum_functions"))
    return search.page(rows, 1, ["sum_ast", "sum_functions", "origin"])


# --- texts and scripts -----------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%m/%d/%Y') AS short, strftime(ts, '%d-%b-%Y %H:%M:%S') || '+0000' AS log FROM events")
def q_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", text.short_date(time).alias("short"), text.log_time(time).alias("log"))


@query("SELECT p_partkey, p_name || ' é' AS utf8, p_name || ' é' AS latin1 FROM part")
def q_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in UTF-8, and in Latin-1, where é is one byte that is no UTF-8."""
    utf8, latin1 = (F.concat(F.col("p_name").cast("binary"), F.unhex(F.lit(x))) for x in ("20C3A9", "20E9"))
    return table(spark, sf_dir, "part").select("p_partkey", text.decoded(utf8).alias("utf8"), text.decoded(latin1).alias("latin1"))


@query("""SELECT p_partkey, p_partkey % 2 = 0 AS packed, CASE WHEN p_partkey % 2 = 0 THEN 'go' || p_size || '("' || lower(p_brand) || '");' ELSE 'plain();' END AS code FROM part""")
def q_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, brand = F.col("p_size").cast("string"), F.lower("p_brand")
    words = F.concat(F.lit("go"), size, F.lit("|"), F.regexp_replace(brand, "#", "|"))
    packed = F.concat(F.lit("""eval(function(p,a,c,k,e,d){return p}('0("1#2");',10,3,'"""), words, F.lit("'.split('|'),0,{}))"))
    code = F.when(F.col("p_partkey") % 2 == 0, packed).otherwise("plain();")
    return table(spark, sf_dir, "part").select("p_partkey", text.is_packed(code).alias("packed"), unpacked(code).alias("code"))


# --- sources and sinks -----------------------------------------------------------------------


@query("SELECT 'https://' || lower(replace(c_name, '#', '')) AS url FROM customer")
def q_seed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "seeds")
    names = table(spark, sf_dir, "customer").select(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))).alias("value"))
    names.union(spark.createDataFrame([("",), ("   ",)], "value string")).write.text(at)
    return topics.seed_urls(spark, at)


def _script_files(spark: SparkSession, sf_dir: str) -> str:
    """A tree with a small script for each of the 25 nations, written through the file system of the shared folder."""
    at, context = new_path(spark, "tree"), spark.sparkContext
    for n in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        below = ["tags/{r}/js/{n}.min.js", "tags/{r}/i18n/{n}.js", "trunk/{n}.js", "tags/{r}/{n}.txt", "tags/{r}/{n}.js"][n.n_nationkey % 5]
        path = context._jvm.org.apache.hadoop.fs.Path(f"{at}/" + below.format(r=f"1.{n.n_regionkey}", n=n.n_name.replace(" ", "_")))
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(b"go();" * (n.n_nationkey + 1)))
        out.close()
    return at


_TREE = """t AS (SELECT n_nationkey AS k, '1.' || n_regionkey AS r, replace(n_name, ' ', '_') AS n, 5 * (n_nationkey + 1) AS size_bytes FROM nation),
f AS (SELECT *, CASE k % 5 WHEN 0 THEN 'tags/' || r || '/js/' || n || '.min.js' WHEN 1 THEN 'tags/' || r || '/i18n/' || n || '.js' WHEN 2 THEN 'trunk/' || n || '.js' WHEN 3 THEN 'tags/' || r || '/' || n || '.txt' ELSE 'tags/' || r || '/' || n || '.js' END AS loc FROM t)"""


@query(f"WITH {_TREE} SELECT 'nations' AS family, '2.0' AS release, 'https://cdn.example/2.0/' || loc AS origin, size_bytes, sha256(repeat('go();', size_bytes // 5)) AS sha256 FROM f WHERE loc LIKE '%.js'")
def q_tree_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _script_files(spark, sf_dir)
    return files.tree_controls(spark, at, "https://cdn.example/", "nations", "2.0").select("family", "release", "origin", "size_bytes", F.sha2("code", 256).alias("sha256"))


@query(f"WITH {_TREE} SELECT 'nations' AS family, r AS release, 'https://cdn.example/' || loc AS origin, size_bytes FROM f WHERE loc LIKE 'tags/%.js' AND NOT loc LIKE '%/i18n/%'")
def q_plugin_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _script_files(spark, sf_dir)
    return files.plugin_controls(spark, at, "https://cdn.example/", "nations").select("family", "release", "origin", "size_bytes")


@query("""WITH p AS (SELECT 'p' || p_size AS name, CASE WHEN p_partkey % 2 = 0 THEN 'gh' ELSE 'npm' END AS provider, '1.' || p_partkey AS version, '/' || replace(p_name, ' ', '/') || CASE WHEN p_partkey % 3 = 0 THEN '.css' ELSE '.js' END AS file FROM part),
f AS (SELECT name, min(provider) AS provider FROM p GROUP BY name)
SELECT 'https://cdn.example/' || provider || '/' || name || '@' || version || file AS url, name, version FROM p JOIN f USING (name, provider) WHERE file LIKE '%.js' AND contains(version, '1')""")
def q_package_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    file = F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.when(key % 3 == 0, ".css").otherwise(".js"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_size").alias("name"), F.when(key % 2 == 0, "gh").otherwise("npm").alias("provider"), F.concat(F.lit("1."), key).alias("version"), file.alias("file"))
    versions = rows.groupBy("name", "provider", "version").agg(F.collect_list("file").alias("files"))
    packages = versions.groupBy("name", "provider").agg(F.collect_list(F.struct("version", "files")).alias("versions"))
    return files.package_catalog(packages, "https://cdn.example", version="1").select("url", "name", "version")


@query("""SELECT family, origin, n_new, n_known FROM (SELECT p_brand AS family, count(*) FILTER (WHERE p_size * 100 >= 1000 AND p_partkey % 3 <> 0) AS n_new, count(*) FILTER (WHERE p_partkey % 3 = 0) AS n_known, 'https://cdn.example/' || p_brand AS origin FROM part GROUP BY p_brand)""")
def q_upload_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog, acceptance, analysis and the three tables of an upload, counted by family."""
    key = F.col("p_partkey")
    code = F.concat(F.lit("go"), key, F.lit("();")).cast("binary")
    # written, as the optimiser would move the analysis in front of the dealing
    rows = materialised(spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")), "parts")
    rows = rows.select(F.concat(F.lit("https://cdn.example/"), "p_brand", F.lit("/"), key, F.lit(".js")).alias("origin"), F.col("p_brand").alias("family"), code.alias("code"), (F.col("p_size") * 100).alias("padded"))
    # a script's size is what the part's says
    rows = rows.select("origin", "family", F.rpad(F.col("code").cast("string"), F.col("padded"), F.lit(" ")).cast("binary").alias("code"))
    known = artefact.with_hashes(rows).where(F.regexp_extract("origin", r"(\d+)\.js$", 1).cast("int") % 3 == 0)
    made = artefact.uploaded_controls(rows, known, analysed(F.col("code")))
    new, code_rows, summary = made["javascript_controls"], made["javascript_control_code"], made["javascript_controls_summary"]
    stored = new.join(code_rows.select("origin"), "origin").join(summary.where("sum_of_functions = 1").select("origin"), "origin")
    n = stored.groupBy("family").agg(F.count("*").alias("n_new"))
    out = known.groupBy("family").agg(F.count("*").alias("n_known")).join(n, "family", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    families = rows.select("family").distinct().join(out, "family", "left")
    return families.select("family", F.concat(F.lit("https://cdn.example/"), "family").alias("origin"), zero("n_new"), zero("n_known"))


@query("SELECT p_partkey, p_name, 'a,' || p_brand AS tags FROM part")
def q_tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_path(spark, "tsv")
    files.write_tsv(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.array(F.lit("a"), "p_brand").alias("tags")), at)
    return spark.read.option("sep", "\t").option("header", "true").schema("p_partkey long, p_name string, tags string").csv(at)


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation")
def q_replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended rows, of which one partition is then replaced."""
    at, rows = new_path(spark, "parts"), table(spark, sf_dir, "nation")
    files.replace_partitions(rows.where("n_regionkey < 3"), at, "n_regionkey")
    rows.where("n_regionkey >= 3").write.mode("append").partitionBy("n_regionkey").parquet(at)
    files.replace_partitions(rows.where("n_regionkey = 1").withColumn("n_name", F.lower("n_name")), at, "n_regionkey")
    return spark.read.parquet(at).select("n_nationkey", "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation")
def q_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, rows = new_path(spark, "appended"), table(spark, sf_dir, "nation")
    files.append(rows.select(F.col("n_nationkey").alias("k")), at)
    files.append(rows.select((F.col("n_nationkey") + 100).alias("k")), at)
    return spark.read.parquet(at)


@query("""SELECT n_nationkey, '{' || chr(10) || '  "n_nationkey" : ' || n_nationkey || ',' || chr(10) || '  "n_name" : "' || n_name || '"' || chr(10) || '}' AS value FROM nation""")
def q_pretty_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = files.pretty(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return shown.select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("n_nationkey"), "value")


@query("SELECT 'https://controls.example/' || p_partkey AS origin, 'go' || p_size || '();' AS code FROM part WHERE p_partkey = 17")
def q_exported_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("go"), "p_size", F.lit("();")).cast("binary")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("https://controls.example/"), "p_partkey").alias("js_id"), code.alias("code"))
    return files.code_of(rows, "https://controls.example/17").select(F.col("js_id").alias("origin"), F.col("code").cast("string").alias("code"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's daily counts; what each batch updates, and of that the last."""
    out = collected(spark, sf_dir, lambda s: pipelines.windowed_counts(s, "event_type", "ts", "1 day", "60 days"), "update")
    return out.groupBy("start", "event_type").agg(F.max("n").alias("n")).select(F.to_date("start").alias("day"), "event_type", "n")


@query("""SELECT user_id::VARCHAR AS key, '{"event_id":' || event_id || ',"user_id":' || user_id || '}' AS value FROM events WHERE event_type = 'click'""")
def q_keyed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics.next_artefacts(table(spark, sf_dir, "events"), F.col("event_type") == "click")
    return topics.keyed(rows.select("event_id", "user_id"), "user_id")


@query("SELECT event_type, least(count(*), 50) AS n FROM events GROUP BY event_type HAVING event_type = 'click'")
def q_next_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of at most fifty records pass: filter first, then limit."""
    rows = topics.next_artefacts(table(spark, sf_dir, "events"), F.col("event_type") == "click", 50)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events")
def q_topic_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = topics.TopicOptions(path=new_path(spark, "topic"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    topics.write_batch(rows, at)
    return topics.read_batch(spark, at, rows.schema)


# --- daemons ---------------------------------------------------------------------------------


def _ran(spark: SparkSession, program: programs.Program, records: DataFrame) -> str:
    """The warehouse of a program that ran over records once; they lie in two files, so there are two batches."""
    at = new_path(spark, "warehouse")
    records.repartition(2).write.json(programs.output(at, program.source))
    programs.start(spark, program, at, f"{at}/checkpoint").awaitTermination()
    return at


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'seen' ELSE 'rest' END AS route FROM events")
def q_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream to three sinks."""
    at, kind = new_path(spark, "routes"), F.col("event_type")
    routes = {"failed": kind == "error", "seen": kind == "view", "rest": ~kind.isin("error", "view")}
    sinks = {name: (lambda b, name=name: files.append(b.select("event_id", F.lit(name).alias("route")), f"{at}/{name}")) for name in routes}
    pipelines.run(_events(spark, sf_dir), topics.fan_out(routes, sinks), f"{at}-checkpoint").awaitTermination()
    return spark.read.schema("event_id long, route string").option("recursiveFileLookup", "true").parquet(at)


@query("SELECT event_id, n_name FROM events LEFT JOIN nation ON n_nationkey = user_id WHERE event_type <> 'error' UNION ALL SELECT event_id, 'failed' FROM events WHERE event_type = 'error'")
def q_enriched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with a dimension as it is at each batch; failures go their own way."""
    at = new_path(spark, "enriched")
    names = lambda: table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    good = lambda b: files.append(b.select("event_id", "n_name"), f"{at}/good")
    bad = lambda b: files.append(b.select("event_id", F.lit("failed").alias("n_name")), f"{at}/bad")
    each = lambda b: pipelines.split_failures(b, F.col("event_type") == "error", good, bad)
    pipelines.run(_events(spark, sf_dir), pipelines.with_dimension(names, "user_id", each), f"{at}-checkpoint").awaitTermination()
    return spark.read.schema("event_id long, n_name string").option("recursiveFileLookup", "true").parquet(at)


@query("""WITH r AS (SELECT p_size AS k, max(p_type) AS t FROM part GROUP BY p_size)
SELECT 'https://a.example/' || k || '.js' AS url, CASE WHEN k % 10 = 0 THEN NULL ELSE 1::BIGINT END AS n_calls, CASE WHEN k % 10 = 0 THEN NULL ELSE 1::BIGINT END AS n_literals,
CASE WHEN k % 10 = 0 THEN 'cannot be analysed' WHEN k % 10 = 1 THEN 'is not stored' END AS reason FROM r WHERE k % 10 <> 1
UNION ALL SELECT 'https://a.example/' || k || '.js', NULL, NULL, 'is not stored' FROM r WHERE k % 10 = 1""")
def q_features_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every script twice in the topic, and once too small; some are damaged or not stored."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("k")).agg(F.max("p_type").alias("t"))
    code = F.concat(F.lit("go"), "k", F.lit('("'), "t", F.lit('")'), F.when(F.col("k") % 10 == 0, "(").otherwise(";")).cast("binary")
    rows = artefact.with_hashes(rows.withColumn("code", code)).withColumn("js_id", artefact.content_id())
    web = F.concat(F.lit("https://a.example/"), "k", F.lit(".js"))
    records = rows.select(web.alias("url"), "sha256", "md5", "js_id", F.lit(False).alias("inline"), F.lit("text/javascript").alias("content_type"), F.lit("2024-01-01").alias("when"), F.lit(1500).alias("size_bytes"), F.lit("https://a.example/").alias("origin"))
    small = records.withColumns({"size_bytes": F.lit(1499), "url": F.lit("small")})
    at = _ran(spark, programs.features(rows.where("k % 10 <> 1").select("js_id", "code")), records.union(records).union(small))
    good = programs.written(spark, at, "analysis-results", programs.ANALYSED)
    bad = programs.written(spark, at, "feature-extraction-failures", schemas._struct("url string, reason string"))
    found = good.select("url", V.map_total(F.col("calls_by_count")).alias("n_calls"), V.map_total(F.col("literals_by_count")).alias("n_literals"), F.lit(None).cast("string").alias("reason"))
    return found.union(bad.select("url", F.lit(None).cast("long"), F.lit(None).cast("long"), F.regexp_extract("reason", "(cannot be analysed|is not stored)", 1)))


@query("""WITH h AS (SELECT event_id, user_id, event_id % 60 AS ast_dist, (event_id % 7)::DOUBLE AS function_dist, (event_id % 5)::DOUBLE AS literal_dist FROM events),
j AS (SELECT *, CASE WHEN ast_dist < 20 AND ast_dist > 0 AND function_dist > 0 THEN true
  WHEN (ast_dist * 0.8 + function_dist * 1.5) * (function_dist * 1.5 + literal_dist) + ast_dist * 0.8 + function_dist * 1.5 + literal_dist <= 100 THEN true
  WHEN least(ast_dist, function_dist, literal_dist) * (ast_dist + function_dist + literal_dist - least(ast_dist, function_dist, literal_dist) - greatest(ast_dist, function_dist, literal_dist)) < 25 THEN true ELSE false END AS ok FROM h)
SELECT 'x' || event_id AS xref, ok, CASE WHEN ok THEN 'f' || user_id % 10 END AS control_family, CASE WHEN ok THEN 'a.example' END AS origin_host FROM j WHERE NOT ok OR user_id % 10 <> 3""")
def q_publish_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://controls.example/"), F.col("user_id") % 10).alias("control_url"), F.lit("https://a.example/x.js").alias("origin_url"), F.lit("https://b.example/").alias("cited_on"),
        F.concat(F.lit("x"), e).alias("xref"), (e % 60).cast("double").alias("ast_dist"), (e % 7).cast("double").alias("function_dist"), (e % 5).cast("double").alias("literal_dist"), F.lit("go").alias("diff_functions"))
    known = spark.range(10).where("id <> 3").select(F.concat(F.lit("https://controls.example/"), "id").alias("origin"), F.concat(F.lit("f"), "id").alias("family"))
    at = _ran(spark, programs.publish(known, 100.0), rows)
    kind = schemas._struct("xref string, control_family string, origin_host string")
    good, bad = (programs.written(spark, at, name, kind) for name in ("etl-good-hits", "etl_bad_hits"))
    none = F.lit(None).cast("string")
    return good.select("xref", F.lit(True).alias("ok"), "control_family", "origin_host").union(bad.select("xref", F.lit(False), none, none))


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), n AS (SELECT *, length(host) % 30 AS k FROM h)
SELECT 'https://' || host || '/x.js' AS script, n_name AS country, '10.' || k || '.0.7' AS ip FROM n JOIN nation ON n_nationkey = k WHERE n_name <> 'NATION_3'""")
def q_geolocate_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = url.hostname(F.col("url"))
    hosts = table(spark, sf_dir, "pages").select(host.alias("host")).distinct()
    # a page names its own host's script, which is not asked for, and a foreign one twice
    script = F.concat(F.lit("https://"), "host", F.lit("/x.js"))
    records = hosts.select(F.lit("https://page.example/").alias("url"), F.lit("t").alias("when"), F.concat_ws(" ", F.lit("https://page.example/own.js"), script, script).alias("scripts"))
    addresses = hosts.select("host", F.concat(F.lit("10."), F.length("host") % 30, F.lit(".0.7")).alias("ip"))
    first = F.lit(167772160) + F.col("n_nationkey").cast("long") * 65536
    ranges = table(spark, sf_dir, "nation").select(first.alias("start"), (first + 65535).alias("stop"), F.col("n_name").alias("country"))
    at = _ran(spark, programs.geolocate(addresses, ranges, "NATION_3"), records)
    return programs.written(spark, at, "javascript-geolocation", schemas.JAVASCRIPT_LOCATION).select("script", "country", "ip")


@query("SELECT 'https://u' || user_id || '.example/' || event_id AS url, 'sum' || event_id AS checksum FROM events WHERE user_id % 3 = 1 AND event_type <> 'view'")
def q_upload_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://u"), "user_id", F.lit(".example/"), "event_id").alias("url"), F.when(F.col("event_type") != "view", "https://page.example/").alias("origin"),
        F.concat(F.lit("crawler"), F.col("user_id") % 3).alias("host"), F.concat(F.lit("sum"), "event_id").alias("checksum"))
    at = _ran(spark, programs.upload("crawler1"), rows)
    return programs.written(spark, at, "uploads", schemas.DOWNLOAD_ARTEFACT).select("url", "checksum")
