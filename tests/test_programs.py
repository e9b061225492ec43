"""The programs over small stored tables."""

import pytest
from pyspark.sql import functions as F

from oreflow import __main__ as programs
from oreflow.plans import analogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("warehouse")
    hits = analogue.hits(spark, SF).withColumn("created_at", F.col("created_at").cast("timestamp"))
    controls = analogue.controls(spark, SF)
    count = F.create_map(F.lit("Name"), F.lit(60))
    controls = controls.withColumns({"sha256": F.sha2("origin", 256), "statements_by_count": count, "calls_by_count": F.create_map(F.col("family"), F.lit(1)), "literals_by_count": count})
    scripts = spark.createDataFrame([("j1", "h", "m", 9, bytearray(b"go('x')"))], "js_id string, sha256 string, md5 string, size_bytes int, code binary")
    results = controls.limit(5).select(F.col("family").alias("artefact_id"), F.col("origin").alias("url"), F.lit("http://a.b/").alias("origin"), F.lit("j").alias("js_id"), "sha256", "statements_by_count", "calls_by_count", "literals_by_count").dropDuplicates(["artefact_id"])
    tables = {
        "etl_hits": hits, "etl_bad_hits": hits.withColumn("sha256", F.sha2("control_url", 256)), "javascript_controls": controls, "javascript_control_code": controls.select("origin"), "scripts": scripts,
        "analysis_content": scripts.select("js_id").limit(0), "analysis_results": results, "vet_against_control": hits.withColumns({"diff_functions": F.array_join("diff_functions", " "), "origin_js_id": F.lit("j")}).drop("cited_on_host", "cited_on_path"),
        "urls": hits.select(F.col("cited_on").alias("url")), "javascript_download_failure": spark.createDataFrame([("u", 503)], "url string, http_status int"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{at}/{name}")
    programs.main(["--warehouse", str(at), "--out", f"{at}/function_probabilities", "--format", "parquet", "probabilities"], spark)
    (at / "seeds").write_text("a.com\nb.com\n")
    return str(at)


@pytest.mark.parametrize("arguments", [
    *(["report", "--query", q, "--extra", {"family_hits": "Brand#1", "subfamily_hits": "promo", "control_hits": "https://controls.example/17", "host": "s1"}.get(q, ""), "--min-sites", "1"] for q in programs.REPORTS if q != "unresolved_clusters"),
    ["search", "--by", "host", "--text", "s1"], ["search", "--by", "control", "--text", "17"], ["search", "--by", "function", "--text", "PROMO"], ["search", "--by", "distance", "--least", "0", "0", "0", "--most", "9", "9", "9"],
    ["features", "--only-new"], ["evaluate", "--min-size", "100"], ["publish"], ["publish", "--threshold", "1", "--bad"], ["outliers", "--family", "Brand"], ["purge", "--where", "size_bytes < 1000", "--table", "etl_hits"],
    ["subfamilies", "--list"], ["subfamilies", "--dry-run"], ["recalc", "--control", "https://controls.example/17"], ["summary"], ["blacklist", "--threshold", "1"], ["retry"], ["stats", "--least", "1"],
    ["dump", "--topic", "urls", "--n", "3"], ["seeds", "--file", "SEEDS"], ["pairwise", "--left", "https://controls.example/1", "--right", "https://controls.example/2"], ["artefact", "--js-id", "j1"],
], ids=lambda a: "-".join(a[:3]))
def test_program(spark, warehouse, tmp_path, arguments):
    arguments = [f"{warehouse}/seeds" if x == "SEEDS" else x for x in arguments]
    rows = programs.main(["--warehouse", warehouse, "--out", str(tmp_path / "out"), "--format", "json", *arguments], spark)
    assert rows.count() > 0 or arguments[0] == "recalc"


def test_clusters_without_controls(spark, warehouse, tmp_path):
    rows = programs.main(["--warehouse", warehouse, "--out", str(tmp_path / "out"), "report", "--query", "unresolved_clusters", "--min-sites", "1"], spark)
    assert rows.count() == 0


def test_missing_parameter(spark, warehouse):
    with pytest.raises(SystemExit):
        programs.main(["--warehouse", warehouse, "report", "--query", "host"], spark)
