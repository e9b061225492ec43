"""Operators on small tables, against plain Python models."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oreflow import schemas
from oreflow.operators import artefact, crawl, maintenance, match, outlier, rarity, report, search
from oreflow.sources import files, topics


def test_range_join_is_the_nested_loop(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(-500, 500)) for i in range(150)]
    b = [(i, rng.uniform(-500, 500)) for i in range(150)] + [(999, a[0][1] - 55.0), (998, a[0][1] + 55.0)]
    left, right = spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double")
    for half in (0.4, 55.0, 2000.0):
        got = {(r.i, r.j) for r in match.range_join(left, right, "x", "y", half).collect()}
        assert got == {(i, j) for i, x in a for j, y in b if x - half <= y < x + half}


def _fold(candidates, most):
    """The search for the best control, one candidate after the other."""
    inf = math.inf
    composite = lambda c: (c["ast"] * 0.8 + c["fn"] * 1.5) * (c["fn"] * 1.5) + c["ast"] * 0.8 + c["fn"] * 1.5
    best, second, nearest = {"url": "", "composite": inf, "sha": False}, None, inf
    for c in candidates:
        total = c["total"]
        if not (total < nearest and total <= most):
            continue
        hit = {"url": c["url"], "composite": composite(c), "sha": False}
        if best["composite"] < hit["composite"]:
            if second is None or second["composite"] > hit["composite"]:
                second = hit
        else:
            best, second, nearest = hit, best, total
            if total < 1e-5:
                best["sha"] = c["sha"]
                break
    return best, second


def test_fold_is_the_sequential_search(spark):
    rng = random.Random(3)
    groups, rows = {}, []
    for g in range(300):
        groups[g] = []
        for k in range(rng.randint(0, 7)):
            ast, fn = rng.choice([0.0, 0.0, 1.0, 5.0, 20.0, 90.0]), rng.choice([0.0, 0.0, 2.0, 9.0, 50.0, math.inf])
            total = ast * 0.75 * fn + (ast + fn) * 0.5 if not (ast == 0 and fn == math.inf) else math.nan
            c = {"url": f"c{k}", "ast": ast, "fn": fn, "total": total, "sha": rng.random() < 0.5}
            groups[g].append(c)
            rows.append((g, 0, c["url"], total, ast, fn, c["sha"]))
    table = spark.createDataFrame(rows, "g int, strategy int, origin string, total double, ast_dist double, function_dist double, same_sha boolean")
    cols = ["strategy", "origin", "total", "ast_dist", "function_dist", "same_sha"]
    out = table.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("c")).select("g", match.fold_best(F.col("c"), 200.0).alias("f"))
    for r in out.collect():
        best, second = _fold(groups[r.g], 200.0)
        assert (r.f.best.control_url, r.f.best.sha256_matched) == (best["url"], best["sha"]), r.g
        assert (r.f.second.control_url if r.f.second else None) == (second["url"] if second else None), r.g


def _artefacts(spark):
    maps = "statements_by_count map<string,int>, calls_by_count map<string,int>, literals_by_count map<string,int>"
    big = {"Name": 100, "Block": 20}
    own = [("a1", "http://x.au/s.js", "http://x.au/", "j1", "h1", big, {"f": 3, "g": 1}, {"l": 1}), ("a2", "http://y.au/t.js", "http://y.au/p", "j2", "h2", {"Name": 1}, {}, {})]
    controls = [("http://c/1", "h1", False, 2000, "fam", "sub", big, {"f": 3, "g": 1}, {"l": 1}), ("http://c/2", "h9", False, 2000, "fam", "sub", {"Name": 101, "Block": 20}, {"f": 3, "g": 2}, {"l": 2}), ("http://c/3", "h1", True, 2000, "fam", "sub", big, {"f": 3, "g": 1}, {})]
    return (
        spark.createDataFrame(own, f"artefact_id string, url string, origin string, js_id string, sha256 string, {maps}"),
        spark.createDataFrame(controls, f"origin string, sha256 string, do_not_load boolean, size_bytes int, family string, subfamily string, {maps}"),
    )


def test_best_control_end_to_end(spark):
    own, controls = _artefacts(spark)
    got = {(r.artefact_id, r.rank): r for r in match.evaluate(own, controls).collect()}
    best = got["a1", 0]
    assert (best.control_url, best.sha256_matched, best.ast_dist, best.function_dist, best.literal_dist) == ("http://c/1", True, 0.0, 0.0, 0.0)
    nothing = got["a2", 0]
    assert (nothing.control_url, nothing.literal_dist, nothing.n_diff_literals) == ("", -1.0, -1) and nothing.ast_dist == math.inf
    good, bad = match.publish(match.evaluate(own, controls), controls)
    assert [(r.control_url, r.origin_host, r.cited_on_port, r.control_family) for r in good.collect()] == [("http://c/1", "x.au", 80, "fam")]
    assert [r.reason for r in bad.collect()] == ["bad_literal_dist"]


def test_strategies(spark):
    a = spark.createDataFrame([("a", 100, 70), ("b", 10, 60)], "artefact_id string, sum_ast int, sum_calls int")
    s = spark.createDataFrame([("c1", 105, 1000), ("c2", 5000, 65), ("c3", 10, 10)], "origin string, sum_ast int, sum_calls int")
    got = lambda *x: {(r.artefact_id, r.origin, r.strategy) for r in match.plausible_controls(a, s, 20.0, *x).collect()}
    assert got() == {("a", "c1", 0), ("a", "c2", 1), ("b", "c2", 1)} and got(("ast",)) == {("a", "c1", 0)}


@pytest.mark.parametrize("block", [1000, 7, 1])
def test_nearest_of_any_number_of_controls(spark, block):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, (40, 2)).astype(float), rng.integers(0, 6, (30, 2)).astype(float)
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())], "id long, v array<double>")
    found = match.nearest(frame(a), frame(b), "id", "id", "v", block=block).collect()
    gaps = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert len(found) == 41 and all((r.control_id, r.dist) == (int(gaps[r.id].argmin()), gaps[r.id].min()) for r in found)
    assert all(r.control_id is None for r in match.nearest(frame(a), frame(b).limit(0), "id", "id", "v", block=block).collect())


def test_poor_hits(spark):
    hits = spark.createDataFrame([("http://a/x", "http://b/", 60.0), ("http://a/y", "http://b/", 40.0)], "origin_url string, cited_on string, ast_dist double")
    got = match.poor_hits(hits, spark.createDataFrame([("http://a/x", "h")], "url string, sha256 string")).collect()
    assert [(r.origin_url, r.cited_on_host, r.sha256) for r in got] == [("http://a/x", "b", "h")]


def test_suitability(spark):
    rows = [("ftp://a.au/", 0, False, 0, 0, 1, False, 1, False), ("http:///x", 0, False, 0, 0, 1, False, 1, False), ("http://a.au/", 3, True, 0, 0, 1, False, 1, False), ("http://a.au/", 0, True, 99, 0, 1, False, 1, False),
            ("http://a.au/", 0, False, 21, 0, 1, False, 9, True), ("http://a.au/", 0, False, 20, 0, 11, False, 1, False), ("http://a.com/", 0, False, 0, 0, 1, False, 4, True), ("http://a.au/", 0, False, 0, 0, 1, False, 4, False)]
    table = spark.createDataFrame(rows, "url string, n_seen int, is_blacklisted boolean, n_recent int, n_site_cache int, rank_in_batch int, is_banned boolean, priority int, is_outside boolean")
    got = [r.reject_reason for r in crawl.suitability(table, crawl.standard_criteria()).collect()]
    assert got == ["bad_scheme", "no_host", "recently_seen", "blacklisted", "recently_crawled", "congested_batch", "outside_au", None]
    assert [x for x, _ in crawl.snippet_criteria()] == ["blacklisted", "long_term_banned"]
    counts = {r.reject_reason: r.n for r in crawl.reject_counts(crawl.suitability(table, crawl.snippet_criteria())).collect()}
    assert counts[None] == 4


def test_page_stats_are_the_crawlers_loop(spark):
    """Repeats count as links, urls are told apart with their fragments, and runs stop behind the limit."""
    from urllib.parse import urljoin, urlparse

    from oreflow.functions import url

    rng = random.Random(2)
    rows = []
    for i in range(60):
        links = [rng.choice([f"/a{rng.randrange(40)}", f"#f{rng.randrange(3)}", f"http://o{rng.randrange(90)}.net/", "mailto:x", f"http://bad.net/{rng.randrange(9)}", "http://sub.h.com/"]) for _ in range(rng.choice([0, 5, 200]))]
        rows.append((f"http://h.com/{i}", "".join(f'<a class=x href="{x}">y</a>' for x in links), i % 30, links))
    pages = spark.createDataFrame([r[:3] for r in rows], "url string, html string, seen int")
    suitable = lambda x: crawl.may_follow(x) & (url.hostname(x) != "bad.net")
    found = {r.url: r for r in crawl.page_stats(crawl.page_links(pages), F.col("seen"), suitable=suitable).collect()}
    for page, _, seen, links in rows:
        absolute = [urljoin(page, x) for x in links]
        external, internal = {x for x in absolute if "h.com" not in x}, {x for x in absolute if "h.com" in x}
        limit = 100 - 4 * min(seen, 20)

        def followed(some, most):
            sent = 0
            for x in some:
                if x.startswith("http") and urlparse(x).hostname != "bad.net":
                    sent += 1
                    if sent > most:
                        break
            return sent

        n = followed(external, limit)
        inside = followed(internal, min(max(limit - n, 0), 20)) if seen < 20 else 0
        r = found[page]
        assert (r.n_hrefs, r.n_hrefs_max_permitted, r.n_external, r.n_external_accepted, r.n_internal, r.n_internal_accepted) == (len(links), limit, len(external), n, len(internal), inside)


def test_page_scripts(spark):
    pages = spark.createDataFrame([("http://h.com/p/", '<script src="a.js"></script><script src="a.js"></script><script src="http://o.net/b.js"></script><script src="data:x"></script><script src="old.js"></script>'), ("http://n.com/", None)], "url string, html string")
    found = {r.url: r for r in crawl.page_scripts(pages, fetched=spark.createDataFrame([("http://h.com/p/old.js",)], "url string")).collect()}
    r = found["http://h.com/p/"]
    assert r.scripts == "http://h.com/p/a.js http://h.com/p/a.js http://o.net/b.js data:x http://h.com/p/old.js" and (r.n_scripts, r.n_scripts_accepted) == (5, 2)
    assert (found["http://n.com/"].n_scripts, found["http://n.com/"].n_scripts_accepted) == (0, 0)


def test_page_scripts_of_one_url(spark):
    pages = spark.createDataFrame([("http://h.com/", '<script src="a.js"></script>'), ("http://h.com/", '<script src="b.js"></script>'), ("http://h.com/", None)], "url string, html string")
    fetched = spark.createDataFrame([("http://h.com/a.js",)], "url string")
    assert sorted((r.n_scripts, r.n_scripts_accepted, r.scripts) for r in crawl.page_scripts(pages, fetched=fetched).collect()) == [(0, 0, ""), (1, 0, "http://h.com/a.js"), (1, 1, "http://h.com/b.js")]


def test_crawl_tables(spark):
    pages = spark.createDataFrame([("http://h.com/p", '<a href="/x#y"></a><a href="http://o.net/z"></a><a href="mailto:a"></a>'), ("http://n.com/", "none")], "url string, html string")
    got = {r.url: r for r in crawl.page_links(pages).collect()}
    assert got["http://h.com/p"].internal == ["http://h.com/x#y"] and "http://o.net/z" in got["http://h.com/p"].external and got["http://n.com/"].external == []
    stats = {r.url: r for r in crawl.page_stats(crawl.page_links(pages), 25).collect()}
    assert stats["http://h.com/p"].n_hrefs_max_permitted == 20 and stats["http://h.com/p"].n_internal_accepted == 0
    failures = spark.createDataFrame([("u1", 403), ("u1", 403), ("u2", 404), ("u3", 503), ("u4", None), (None, 500)], "url string, http_status int")
    assert {r.url for r in crawl.retry_candidates(failures).collect()} == {"u1", "u3", "u4"}
    assert crawl.failures_of_host(spark.createDataFrame([(["http://a.b/x", "http://c/"],), ([],)], "file_urls array<string>"), "a.b").count() == 1
    urls = spark.createDataFrame([("http://a/x",), ("http://a/x",), ("http://drop.me/",), ("http://a/" + "y" * 300,)], "url string")
    assert [r.url for r in crawl.reprioritised(urls, "drop").collect()] == ["http://a/x"]
    links = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("link"))
    assert crawl.sampled_links(links, "k", 5).count() == 15
    assert [r.n for r in crawl.recent_sites(spark.createDataFrame([("a", 3)], "host string, n int"), spark.createDataFrame([("a", 7)], "host string, n int")).collect()] == [7]
    assert crawl.without_listed(spark.createDataFrame([("a",), ("b",)], "host string"), spark.createDataFrame([("b",)], "domain string")).collect()[0].host == "a"
    latest = crawl.over_represented(spark.createDataFrame([("a", 90, 1), ("a", 85, 2)], "host string, n_pages int, at int"), order="at")
    assert latest.collect()[0].n_pages == 85
    assert spark.range(1).select(crawl.page_penalty(F.lit(404), F.lit("text/html"))).first()[0] == 2


def test_artefact_store(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "at int, code string")
    stored = artefact.with_hashes(rows)
    got = {r["at"]: r for r in artefact.deduplicated(stored, ["at"]).collect()}
    assert [got[k].was_cached for k in (1, 2, 3)] == [False, False, True] and got[1].js_id == got[3].js_id != got[2].js_id
    assert {(r["at"], r.n) for r in artefact.stored_scripts(stored, ["at"]).collect()} == {(1, 2), (2, 1)}
    declared = stored.withColumn("checksum", F.when(F.col("at") == 2, "wrong").otherwise(F.col("md5")))
    sound, damaged = artefact.verified(declared)
    assert sound.count() == 2 and damaged.collect()[0]["at"] == 2
    analyses = spark.createDataFrame([("j1", "stored")], "js_id string, analysis string")
    todo = spark.createDataFrame([("j1",), ("j2",)], "js_id string")
    assert {r.js_id: r.analysis for r in artefact.with_analysis(todo, analyses, F.lit("made")).collect()} == {"j1": "stored", "j2": "made"}
    assert [r.js_id for r in artefact.not_analysed(todo, analyses).collect()] == ["j2"]
    own, controls = _artefacts(spark)
    assert artefact.control_summary(controls).where("origin = 'http://c/2'").first().sum_of_ast_features == 121
    changed = controls.withColumn("calls_by_count", F.when(F.col("origin") == "http://c/1", F.create_map(F.lit("f"), F.lit(9))).otherwise(F.col("calls_by_count")))
    assert [r.origin for r in artefact.inconsistent_vectors(controls, changed).collect()] == ["http://c/1"]


def test_maintenance(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    changes = spark.createDataFrame([("a", 2, "z"), ("a", 0, "w"), ("c", 1, None)], "k string, at int, v string")
    assert {tuple(r) for r in maintenance.upsert(table, changes, ["k"], ["at"]).collect()} == {("a", 2, "z"), ("b", 1, "y"), ("c", 1, None)}
    purged = spark.createDataFrame([("a",)], "origin string")
    assert [r.k for r in maintenance.purge({"t": (table, "k")}, purged)["t"].collect()] == ["a"]
    assert [r.k for r in maintenance.purge({"t": (table, "k")}, purged, dry_run=False)["t"].collect()] == ["b"]
    hits = spark.createDataFrame([("u", "c", False, 0.0, 0.0), ("v", "c", False, 0.0, 0.0), ("u", "c", False, 5.0, 0.0)], "origin_url string, control_url string, sha256_matched boolean, ast_dist double, function_dist double")
    latest = spark.createDataFrame([("u", "h"), ("v", "other")], "url string, sha256 string")
    known = spark.createDataFrame([("c", "h")], "origin string, sha256 string")
    assert sorted((r.origin_url, r.ast_dist, r.sha256_matched) for r in maintenance.corrected_hash_matches(hits, latest, known).collect()) == [("u", 0.0, True), ("u", 5.0, False), ("v", 0.0, False)]
    own, controls = _artefacts(spark)
    vetted = spark.createDataFrame([("j1", "http://c/1"), ("j2", "http://c/9")], "origin_js_id string, control_url string")
    assert {r.artefact_id for r in maintenance.recalculated(vetted, own, controls, "http://c/1").collect()} == {"a1"}


def test_probabilities_are_shares(spark):
    rng = random.Random(5)
    rows = [(f"c{rng.randrange(6)}", f"h{rng.randrange(9)}", f"p{rng.randrange(30)}", rng.random() < 0.1, rng.uniform(0, 9), rng.uniform(0, 9), [f"f{rng.randrange(4)}" for _ in range(rng.randrange(3))]) for _ in range(300)]
    hits = spark.createDataFrame(rows, "control_url string, cited_on_host string, cited_on string, sha256_matched boolean, ast_dist double, function_dist double, diff_functions array<string>")
    controls = spark.createDataFrame([(f"c{i}", f"s{i % 2}") for i in range(6)], "origin string, subfamily string")
    got = rarity.function_probabilities(hits, controls).collect()
    assert got and all(0 < r.sites_probability <= 1 and 0 < r.pages_probability <= 1 and r.n_sites <= r.n_sites_subfamily for r in got)
    assert rarity.controls_with_hits(controls, hits).count() == 6


def test_report_sets(spark):
    rows = [("c", "o", "h", "/1", "x1", 1.0, 2.0, ["b", "a"]), ("c", "o", "h", "/1", "x2", 1.0, 3.0, []), ("c", "o", "h", "/2", "x3", 4.0, 1.0, ["a"])]
    hits = spark.createDataFrame(rows, "control_url string, origin_url string, cited_on_host string, cited_on_path string, xref string, ast_dist double, function_dist double, diff_functions array<string>")
    r = report.distances(hits).first()
    assert (r.min_distance, r.avg_distance, r.max_distance, r.min_function_dist, r.n_pages, r.diff_functions) == (1.0, 2.5, 4.0, 1.0, 2, ["a", "b"])


def test_search_parameters(spark):
    for bad in ({"text": " "}, {"days": 0}):
        with pytest.raises(ValueError):
            search.validated(**bad)
    with pytest.raises(ValueError):
        search.validated(None, None, -1.0)
    with pytest.raises(ValueError):
        search.page(spark.range(3), 0, ["id"])
    assert [r.id for r in search.page(spark.range(250), 3, ["id"]).collect()] == list(range(200, 250))
    assert search.by_distance(spark.createDataFrame([(1.0, 1.0, math.inf)], "ast_dist double, function_dist double, literal_dist double")).count() == 1


def test_matrix_shuffles_hits_once(spark):
    names = ["xref", "control_url", "origin_url", "cited_on", "sha256_matched", *outlier.FEATURES[:-1], "diff_functions"]
    kinds = "xref string, control_url string, origin_url string, cited_on string, sha256_matched boolean, " + ", ".join(f"{c} double" for c in outlier.FEATURES[:-1]) + ", diff_functions array<string>"
    row = lambda x, c, page, d, fs, same=False: (x, c, "o", page, same, d, 1.0, 2.0, 3.0, 4.0, 5.0, fs)
    rows = [row("x1", "c1", "p2", 9.0, ["f", "g"]), row("x1", "c1", "p1", 8.0, ["g", "h"]), row("x2", "c2", "p", 1.0, ["g"]), row("x3", "c3", "p", 1.0, ["z"]), row("x4", "c1", "p", 1.0, []), row("x5", "c1", "p", 1.0, ["f"], True)]
    hits = spark.createDataFrame(rows, kinds)
    probabilities = spark.createDataFrame([("c1", "f", 0.5), ("c1", "h", 0.25), ("c1", "h", 0.2), ("c1", "z", 0.1), ("c2", "g", 0.5)], "control_url string, function_name string, sites_probability double")
    assert set(names) == set(hits.columns)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = outlier.matrix(hits, probabilities)
        got = {r.xref: (r.control_url, r.cited_on, r.ast_dist, r.diff_functions, r.rarest_function, r.rarest_probability) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {"x1": ("c1", "p1", 8.0, ["f", "g", "h"], "h", 0.2), "x2": ("c2", "p", 1.0, ["g"], "g", 0.5), "x3": ("c3", "p", 1.0, ["z"], "z", 1.0)}
    assert plan.count("Exchange hashpartitioning") == 2


def test_outliers(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, len(outlier.FEATURES)))
    x[:10] += 30
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "xref int, " + ", ".join(f"{c} double" for c in outlier.FEATURES))
    got = {r.xref for r in outlier.outliers(rows, 0.06).where("is_outlier").collect()}
    assert set(range(10)) <= got and len(got) <= 14
    assert outlier.outliers(rows.limit(10)).where("is_outlier").count() == 0
    assert {"pc1", "pc2"} <= set(outlier.principal_components(rows).columns)


def test_outliers_count_every_row(spark):
    # more rows than a sample held once: the threshold is the exact quantile of all distances
    rng = np.random.default_rng(4)
    x = rng.normal(size=(24_000, len(outlier.FEATURES)))
    rows = spark.createDataFrame(pd.DataFrame(x, columns=outlier.FEATURES)).withColumn("xref", F.monotonically_increasing_id()).repartition(3)
    got = outlier.outliers(rows, 0.1).toPandas()
    assert got.is_outlier.sum() == 2400
    assert (got.is_outlier == (got.distance > np.quantile(got.distance, 0.9))).all()
    table = rows.select(F.xxhash64(*outlier.FEATURES).alias("hash"), *outlier.FEATURES)
    state = (0.0, np.zeros(7), np.eye(7))
    distance, count, sums, _ = outlier._nearest(table, [state], [12_004])[0]
    d = (x**2).sum(axis=1)
    half = x[np.argsort(d)[:12_004]]
    assert count == 12_004 and np.isclose(distance, np.sort(d)[12_003]) and np.allclose(sums, half.sum(axis=0))


def test_topics(spark, tmp_path):
    rows = spark.createDataFrame([("k", "é", 1)], "key string, name string, n int")
    assert [r.value for r in topics.dump(rows).collect()] == ['{"name":"é","n":1}']
    assert [r.value for r in topics.dump(rows, ["key"], 1).collect()] == ['{"key":"k","name":"é","n":1}']
    where = topics.TopicOptions(path=str(tmp_path / "t"))
    topics.write_batch(rows, where)
    assert topics.read_batch(spark, where, rows.schema).collect() == rows.collect()
    assert [tuple(r) for r in topics.keyed(rows, "key").collect()] == [("k", '{"key":"k","name":"é","n":1}')]
    assert topics.next_artefacts(spark.range(10), F.col("id") > 3, 2).count() == 2
    for bad in ({}, {"path": "x", "start": "never"}, {"path": "x", "bootstrap": "y"}):
        with pytest.raises(ValueError):
            topics.TopicOptions(**bad)
    (tmp_path / "seed").write_text("a.com\n\n b.com \n")
    assert [r.url for r in topics.seed_urls(spark, str(tmp_path / "seed")).collect()] == ["https://a.com", "https://b.com"]


def test_control_files(spark, tmp_path):
    for name in ("tags/1.0/js/a.min.js", "tags/1.0/js/b.js", "tags/1.0/lang/c.js", "trunk/d.js", "tags/2.0/e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("code")
    got = {r.origin for r in files.plugin_controls(spark, str(tmp_path), "http://p", "fam").collect()}
    assert got == {"http://p/tags/1.0/js/a.min.js", "http://p/tags/1.0/js/b.js"}
    assert files.plugin_controls(spark, str(tmp_path), "http://p", "fam", "min").count() == 1
    assert {r.origin for r in files.tree_controls(spark, str(tmp_path), "http://p/", "fam", "9").collect()} >= {"http://p/9/trunk/d.js"}
    found = files.artefact_files(spark.createDataFrame([("j", "trunk/d.js")], "js_id string, path string"), files.binary_files(spark, str(tmp_path)), str(tmp_path))
    assert bytes(found.first().code) == b"code"
    rows = spark.createDataFrame([("a", ["x", "y"])], "k string, l array<string>")
    files.write_tsv(rows.coalesce(1), str(tmp_path / "tsv"))
    assert next((tmp_path / "tsv").glob("*.csv")).read_text() == "k\tl\na\tx,y\n"
    assert files.StoreOptions("/w/").table("t") == "/w/t"
    parts = spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int")
    files.replace_partitions(parts, str(tmp_path / "parts"), "p")
    files.replace_partitions(parts.where("p = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "parts"), "p")
    assert {(r.p, r.v) for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {("a", 9), ("b", 2)}


def test_catalogs(spark):
    library = spark.createDataFrame([("lib", [("1.0", ["a.min.js", "a.js", "i18n/x.js", "s.css"]), ("2.0", ["b.js"])])], "name string, assets array<struct<version:string,files:array<string>>>")
    assert {r.url for r in files.library_catalog(library, "http://c", version="1.0").collect()} == {"http://c/lib/1.0/a.min.js", "http://c/lib/1.0/a.js"}
    packages = spark.createDataFrame([("p", "npm", [("1", ["/x.js"])]), ("p", "gh", [("2", ["/y.js"])]), ("q", "npm", [("3", ["/z.min.js"])])], "name string, provider string, versions array<struct<version:string,files:array<string>>>")
    assert {r.url for r in files.package_catalog(packages, "http://j").collect()} == {"http://j/gh/p@2/y.js", "http://j/npm/q@3/z.min.js"}


def test_schemas(spark):
    assert len(schemas.FEATURE_VECTOR.fields) == 5 + 44 and len(schemas.CONTROL_HIT.fields) == 25
    rows = schemas.conform(spark.createDataFrame([(1, None)], "n int, url string"), schemas.URL, {"url": "none"})
    assert rows.schema.simpleString() == schemas.URL.simpleString() and rows.first().url == "none"
