"""Streams over files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from oreflow.sources import topics
from oreflow.streaming import pipelines

EVENTS = [(i, i % 7, f"2024-01-{1 + i // 10:02d} 00:00:{i % 10:02d}", i % 3) for i in range(100)]


@pytest.fixture
def stream(spark, tmp_path):
    rows = spark.createDataFrame(EVENTS, "id int, host int, ts string, penalty int")
    for n in range(3):
        rows.where(F.col("id") % 3 == n).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    return topics.read_stream(spark, topics.TopicOptions(path=str(tmp_path / "in")), rows.schema)


def _run(stream, tmp_path, mode="append"):
    out = []
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.append([tuple(r) for r in b.collect()])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def test_first_seen(stream, tmp_path):
    got = [r for b in _run(pipelines.first_seen(stream, ["host"], "ts", "60 days").select("host"), tmp_path) for r in b]
    assert sorted(got) == [(i,) for i in range(7)]


def test_counts(stream, tmp_path):
    assert dict(_run(pipelines.counts(stream, "host"), tmp_path, "complete")[-1]) == {h: len([e for e in EVENTS if e[1] == h]) for h in range(7)}


def test_windowed_counts(stream, tmp_path):
    got = [r for b in _run(pipelines.windowed_counts(stream, "host", "ts", "1 day", "60 days"), tmp_path, "update") for r in b]
    last = {}
    for start, host, n in got:
        last[start, host] = max(n, last.get((start, host), 0))
    assert sum(last.values()) == 100


def test_host_penalties(spark, stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col("host").cast("string").alias("host"), "penalty")
    total = {}
    for batch in _run(pipelines.host_penalties(rows), tmp_path, "update"):
        total |= {h: n for h, n, _ in batch}
    assert total == {str(h): sum(e[3] for e in EVENTS if e[1] == h) for h in range(7)}


def test_routes_and_bounded_runs(spark, stream, tmp_path):
    sent = {"even": [], "odd": []}
    routes = {"even": F.col("id") % 2 == 0, "odd": F.col("id") % 2 == 1}
    sinks = {k: (lambda b, k=k: sent[k].extend(r.id for r in b.collect())) for k in sent}
    pipelines.run(stream, topics.fan_out(routes, sinks), str(tmp_path / "ck")).awaitTermination()
    assert sorted(sent["even"]) == list(range(0, 100, 2)) and sorted(sent["odd"]) == list(range(1, 100, 2))
    # a second run over the same checkpoint has nothing left to read
    pipelines.run(stream, topics.fan_out(routes, sinks), str(tmp_path / "ck")).awaitTermination()
    assert len(sent["even"]) == 50
    got = []
    known = spark.createDataFrame([(1, "one")], "host int, name string")
    pipelines.run(stream, pipelines.with_dimension(lambda: known, "host", lambda b: got.extend(b.where("name = 'one'").collect())), str(tmp_path / "ck2")).awaitTermination()
    assert len(got) == len([e for e in EVENTS if e[1] == 1])


def test_failures_go_their_way(spark):
    good, bad = [], []
    pipelines.split_failures(spark.range(10), F.col("id") > 7, lambda b: good.extend(b.collect()), lambda b: bad.extend(b.collect()))
    assert (len(good), len(bad)) == (8, 2)


def test_quality_gate():
    gate = pipelines.QualityGate()
    for n in (100, 100, 100, 100, 300, 100, 100, 100, 100):
        gate.seen(2000, n)
    with pytest.raises(RuntimeError):
        gate.seen(2000, 100)


def test_count_batches(spark):
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).alias("at"))
    got = {r["at"]: r.batch for r in pipelines.count_batches(rows, ["at"], 150).collect()}
    assert got == {i: i // 150 for i in range(1000)}


# --- daemons: what a run over a topic gives is what the batch operators give -------------------

COUNTS = "map<string,int>"


@pytest.fixture(scope="module")
def evaluated(spark):
    from oreflow.operators import match
    from oreflow.streaming import programs

    rows = [(f"http://a/{i}.js", f"{i:024d}", f"s{i % 5}", {"Name": 60 + i % 5, "Block": 3}, {f"f{i % 5}": 60, "g": 2}, {"x": i % 5 + 1}) for i in range(40)]
    artefacts = spark.createDataFrame(rows, f"url string, js_id string, sha256 string, statements_by_count {COUNTS}, calls_by_count {COUNTS}, literals_by_count {COUNTS}")
    artefacts = artefacts.withColumns({"origin": F.lit("http://page/"), "md5": F.lit("m"), "size_bytes": F.lit(2000), "inline": F.lit(False), "content_type": F.lit("text/javascript"), "when": F.lit("t")})
    controls = [(f"http://c/{i}", f"s{i}", {"Name": 60 + i, "Block": 3}, {f"f{i}": 60, "g": 2}, {"x": i + 1}, "fam", False, 2000) for i in range(4)]
    controls = spark.createDataFrame(controls, f"origin string, sha256 string, statements_by_count {COUNTS}, calls_by_count {COUNTS}, literals_by_count {COUNTS}, family string, do_not_load boolean, size_bytes int")
    batch = match.evaluate(artefacts.withColumn("artefact_id", match.hit_id(F.col("url"), F.col("js_id"))), controls, 300.0)
    return programs, artefacts, controls, batch


def _program(spark, program, records, at, **options):
    from oreflow.streaming import programs

    records.repartition(2).write.mode("append").json(programs.output(at, program.source))
    programs.start(spark, program, at, f"{at}/checkpoint", **options).awaitTermination()


def test_evaluate_program(spark, evaluated, tmp_path):
    from oreflow import schemas

    programs, artefacts, controls, batch = evaluated
    program = programs.evaluate(controls, 300.0)
    _program(spark, program, artefacts, str(tmp_path))
    found = programs.written(spark, str(tmp_path), "javascript-artefact-control-results", schemas.BEST_CONTROL)
    key = lambda rows: sorted((r.origin_url, r.control_url, r.xref, r.sha256_matched, r.ast_dist, r.function_dist, r.literal_dist, r.diff_functions) for r in rows.collect())
    assert key(found) == key(batch) and found.count() >= 40
    # what was read is not read again; a new record is
    more = artefacts.limit(1).withColumns({"url": F.lit("http://a/new.js"), "js_id": F.lit("n" * 24)})
    _program(spark, program, more, str(tmp_path))
    again = programs.written(spark, str(tmp_path), "javascript-artefact-control-results", schemas.BEST_CONTROL)
    assert again.count() == batch.count() + again.where("origin_url = 'http://a/new.js'").count() > batch.count()


def test_a_gate_ends_an_evaluation(spark, evaluated, tmp_path):
    programs, artefacts, controls, _ = evaluated
    far = artefacts.withColumn("statements_by_count", F.create_map(F.lit("Name"), F.lit(100_000)))
    program = programs.evaluate(controls, 300.0, gate=pipelines.QualityGate(batch=10, least=5, patience=2), strategies=("ast",))
    with pytest.raises(Exception, match="batches in a row"):
        _program(spark, program, far, str(tmp_path))


def test_dimensions_decide_for_each_url(spark):
    from oreflow.operators import crawl

    hosts = ["bad.com", "ban.com", "busy.com", "a.au", "nz.com", "home.com", "home.com"]
    urls = spark.createDataFrame([(f"http://{h}/{i}",) for i, h in enumerate(hosts)], "url string")
    one = lambda h: spark.createDataFrame([(h,), (h,)], "host string")
    recent = spark.createDataFrame([("busy.com", 30), ("busy.com", 2)], "host string, n int")
    countries = spark.createDataFrame([("nz.com", "NZ"), ("home.com", "AU"), ("home.com", "NZ")], "host string, country string")
    rows = crawl.with_dimensions(urls, one("bad.com"), one("ban.com"), recent, countries)
    got = {r.url.split("/")[2]: (r.is_blacklisted, r.is_banned, r.n_site_cache, r.is_outside) for r in rows.collect()}
    assert rows.count() == 7 and got == {"bad.com": (True, False, 0, True), "ban.com": (False, True, 0, True), "busy.com": (False, False, 30, True), "a.au": (False, False, 0, False), "nz.com": (False, False, 0, True), "home.com": (False, False, 0, False)}
