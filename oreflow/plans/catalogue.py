"""Queries over the tables of a scale-factor folder, and the same in DuckDB's SQL.

The tables hold no hits, pages of a crawl or scripts; analogue.py says what plays them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, url
from ..functions import vector as V
from ..functions.javascript import analysed
from ..operators import artefact, crawl, maintenance, match, outlier, rarity, report, search
from ..session import materialised, spread
from ..sources import files, topics
from ..streaming import pipelines
from .analogue import HITS_SQL, controls, hits, script_tables, table, turns
from .registry import query
from .streams import collected


def _list(c: str) -> F.Column:
    return F.array_join(c, ",").alias(c)


_EXTREMES = ", ".join(f"{f}({c}) AS {f}_{c}" for c in ("ast_dist", "function_dist", "literal_dist") for f in ("min", "max"))


# --- reports ---------------------------------------------------------------------------------


@query(f"""WITH {HITS_SQL}
SELECT control_url, count(DISTINCT cited_on_host) AS n_sites, {_EXTREMES}, max(size_bytes) AS control_bytes
FROM hits JOIN controls ON origin = control_url WHERE ast_dist < 5 OR function_dist < 5 GROUP BY control_url""")
def q_sites_by_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sites_by_control(hits(spark, sf_dir), controls(spark, sf_dir), 5.0)


@query(f"""WITH {HITS_SQL}, near AS (SELECT * FROM hits WHERE ast_dist < 8 AND function_dist < 8),
fns AS (SELECT control_url, origin_url, cited_on_host, string_agg(DISTINCT f, ',' ORDER BY f) AS fs FROM (SELECT *, unnest(diff_functions) AS f FROM near) GROUP BY ALL)
SELECT n.control_url, n.origin_url, n.cited_on_host, min(ast_dist) AS min_distance, round(avg(DISTINCT ast_dist), 6) AS avg_distance, max(ast_dist) AS max_distance,
       min(function_dist) AS min_function_dist, count(DISTINCT cited_on_path) AS n_pages, coalesce(max(fs), '') AS diff_functions
FROM near n LEFT JOIN fns USING (control_url, origin_url, cited_on_host) GROUP BY 1, 2, 3""")
def q_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.distances(hits(spark, sf_dir), 8.0)
    return out.withColumns({"avg_distance": F.round("avg_distance", 6), "diff_functions": _list("diff_functions")})


@query("""SELECT sha256(text) AS sha256, count(DISTINCT source || '/' || doc_id) AS n_js, count(DISTINCT source) AS n_sites, min(source || '/' || doc_id) AS first_origin_url
FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
GROUP BY 1 HAVING count(DISTINCT source) >= 2""")
def q_unresolved_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("sha256", F.sha2("text", 256))
    bad = docs.select("sha256", F.concat_ws("/", "source", "doc_id").alias("origin_url"), F.col("source").alias("cited_on_host"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return report.unresolved_clusters(bad, docs.join(good, "doc_id", "left_semi"), 2)


_CONTROL_HITS = """, rows AS (SELECT * FROM hits WHERE {0}),
fns AS (SELECT control_url, origin_url, string_agg(DISTINCT f, ',' ORDER BY f) AS fs FROM (SELECT *, unnest(diff_functions) AS f FROM rows) GROUP BY ALL)
SELECT r.control_url, r.origin_url, coalesce(max(fs), '') AS diff_functions, count(DISTINCT xref) AS n_hits, """ + _EXTREMES + """,
       max(n_diff_literals) AS max_n_diff_literals, max(literals_not_in_control) AS max_literals_not_in_control, max(literals_not_in_origin) AS max_literals_not_in_origin
FROM rows r LEFT JOIN fns USING (control_url, origin_url) GROUP BY 1, 2"""


@query(f"WITH {HITS_SQL}" + _CONTROL_HITS.format("NOT sha256_matched"))
def q_control_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.control_hits(hits(spark, sf_dir), True).withColumn("diff_functions", _list("diff_functions"))


@query(f"WITH {HITS_SQL}" + _CONTROL_HITS.format("family = 'Brand#12'"))
def q_family_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.family_hits(hits(spark, sf_dir), controls(spark, sf_dir), "Brand#12").withColumn("diff_functions", _list("diff_functions"))


@query(f"WITH {HITS_SQL}" + _CONTROL_HITS.format("lower(subfamily) LIKE '%prom%'"))
def q_subfamily_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.subfamily_hits(hits(spark, sf_dir), controls(spark, sf_dir), "prom").withColumn("diff_functions", _list("diff_functions"))


_TURNS_SQL = r"""turns AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2),
words AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\s+')) AS w FROM turns) WHERE w <> '' GROUP BY 1, 2, 3)"""


@query(f"""WITH {_TURNS_SQL} SELECT t.conv_id || '/' || t.turn AS origin, 0::BIGINT AS sum_statements, coalesce(sum(n), 0)::BIGINT AS sum_calls, count(n) AS sum_literals
FROM turns t LEFT JOIN words w USING (conv_id, turn) GROUP BY t.conv_id, t.turn""")
def q_list_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(
        F.concat_ws("/", "conv_id", "turn").alias("origin"),
        F.map_filter("counts", lambda k, v: F.lit(False)).alias("statements_by_count"),
        F.col("counts").alias("calls_by_count"),
        F.transform_values("counts", lambda k, v: F.lit(1)).alias("literals_by_count"),
    )
    return report.list_controls(rows)


_RARE = """own AS (SELECT control_url, f AS function_name, count(DISTINCT cited_on_host) AS n_sites, count(DISTINCT cited_on) AS n_pages
  FROM (SELECT *, unnest(diff_functions) AS f FROM hits WHERE ast_dist * function_dist < 50 AND NOT sha256_matched) GROUP BY 1, 2),
fam AS (SELECT subfamily, f AS function_name, count(DISTINCT cited_on_host) AS n_sites_subfamily, count(DISTINCT cited_on) AS n_pages_subfamily
  FROM (SELECT *, unnest(diff_functions) AS f FROM hits WHERE ast_dist * function_dist < 50 AND NOT sha256_matched) GROUP BY 1, 2),
probs AS (SELECT control_url, c.subfamily, function_name, n_sites, n_pages, n_sites_subfamily, n_pages_subfamily,
  n_sites / n_sites_subfamily AS sites_probability, n_pages / n_pages_subfamily AS pages_probability
  FROM own JOIN controls c ON c.origin = control_url JOIN fam USING (subfamily, function_name))"""


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrounded, and written once: the table is joined and grouped again by those who use it."""
    return materialised(rarity.function_probabilities(hits(spark, sf_dir), controls(spark, sf_dir)), "probabilities")


@query(f"""WITH {HITS_SQL}, {_RARE} SELECT * REPLACE (round(sites_probability, 6) AS sites_probability, round(pages_probability, 6) AS pages_probability) FROM probs""")
def q_function_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rarity.function_probabilities(hits(spark, sf_dir), controls(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("sites_probability", "pages_probability")})


@query(f"WITH {HITS_SQL}, {_RARE} SELECT subfamily, function_name, n_sites_subfamily AS n_sites, n_pages_subfamily AS n_pages FROM fam")
def q_subfamily_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rarity.subfamily_probability(hits(spark, sf_dir), controls(spark, sf_dir))


@query(f"""WITH {HITS_SQL}, {_RARE}, each AS (SELECT DISTINCT xref, control_url, unnest(diff_functions) AS function_name FROM hits),
p AS (SELECT xref, function_name, coalesce(sites_probability, 1.0) AS p FROM each LEFT JOIN probs USING (control_url, function_name))
SELECT xref, arg_min(function_name, (p, function_name)) AS rarest_function, round(min(p), 6) AS rarest_probability FROM p GROUP BY xref""")
def q_rarest_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).select("xref", "control_url", "diff_functions")
    found = rarity.rarest_function(rows, _probabilities(spark, sf_dir), ["xref"])
    return found.withColumn("rarest_probability", F.round("rarest_probability", 6))


_SUSPICIOUS = " + ".join(f"contains(lower(t), '{x}')::INT" for x in text.SUSPICIOUS_TERMS if x == x.lower())


@query(f"""WITH {HITS_SQL}, {_RARE}, near AS (SELECT * FROM hits WHERE ast_dist * function_dist < 50),
fns AS (SELECT DISTINCT control_url, cited_on_host, unnest(diff_functions) AS f FROM near),
lits AS (SELECT DISTINCT control_url, cited_on_host, diff_literals FROM near),
sus AS (SELECT control_url, cited_on_host, sum({_SUSPICIOUS})::BIGINT AS s FROM (SELECT *, unnest(string_split(diff_literals, ',')) AS t FROM lits) GROUP BY 1, 2),
len AS (SELECT control_url, cited_on_host, sum(length(diff_literals))::BIGINT AS l FROM lits GROUP BY 1, 2),
fl AS (SELECT control_url, cited_on_host, string_agg(f, ',' ORDER BY f) AS fs, count(*) AS nf,
  arg_min(f, (coalesce(sites_probability, 1.0), f)) AS rf, round(min(coalesce(sites_probability, 1.0)), 6) AS rp
  FROM fns LEFT JOIN (SELECT control_url, function_name AS f, sites_probability FROM probs) USING (control_url, f) GROUP BY 1, 2)
SELECT n.control_url, n.cited_on_host, count(DISTINCT cited_on) AS n_pages, max(n_diff_literals) AS max_diff_literals, coalesce(max(nf), 0)::INT AS n_diff_functions,
       max(s) AS n_suspicious, max(l) AS len_diff_literals, coalesce(max(fs), '') AS diff_functions, max(rf) AS rarest_function, max(rp) AS rarest_probability
FROM near n LEFT JOIN fl USING (control_url, cited_on_host) LEFT JOIN sus USING (control_url, cited_on_host) LEFT JOIN len USING (control_url, cited_on_host) GROUP BY 1, 2""")
def q_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.hosts(hits(spark, sf_dir), _probabilities(spark, sf_dir))
    return out.withColumns({"diff_functions": _list("diff_functions"), "rarest_probability": F.round("rarest_probability", 6)})


@query(f"""WITH {HITS_SQL}, near AS (SELECT *, ast_dist * function_dist AS dist_prod FROM hits WHERE NOT sha256_matched AND ast_dist * function_dist < 50 AND regexp_matches(cited_on_host, 's1'))
SELECT xref, dist_prod, control_url, origin_url, cited_on, ast_dist, function_dist, literal_dist FROM near
QUALIFY row_number() OVER (PARTITION BY xref ORDER BY dist_prod, control_url, origin_url, cited_on, ast_dist, function_dist, literal_dist) = 1""")
def q_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.host(hits(spark, sf_dir), "s1")


@query(f"""WITH {HITS_SQL} SELECT family, count(DISTINCT xref) AS n, max(ast_dist) AS max_ast, max(literal_dist) AS max_literal, max(n_diff_literals) AS max_n_diff_literals,
round(stddev_samp(ast_dist), 6) AS stddev_ast FROM hits GROUP BY family HAVING count(DISTINCT xref) >= 50""")
def q_control_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.control_stats(hits(spark, sf_dir), "family", 50).withColumn("stddev_ast", F.round("stddev_ast", 6))


_MATRIX = f"""{HITS_SQL}, {_RARE}, rows AS (SELECT * FROM hits WHERE NOT sha256_matched AND len(diff_functions) > 0),
one AS (SELECT xref, min((control_url, origin_url, cited_on, ast_dist, function_dist, literal_dist, literals_not_in_origin, literals_not_in_control, n_diff_literals)) AS x
  FROM rows GROUP BY xref),
fns AS (SELECT DISTINCT xref, control_url, unnest(diff_functions) AS f FROM rows),
rare AS (SELECT xref, arg_min(f, (coalesce(sites_probability, 1.0), f)) AS rarest_function, min(coalesce(sites_probability, 1.0)) AS rarest_probability,
  string_agg(DISTINCT f, ',' ORDER BY f) AS diff_functions FROM fns LEFT JOIN (SELECT control_url, function_name AS f, sites_probability FROM probs) USING (control_url, f) GROUP BY xref),
matrix AS (SELECT xref, x[1] AS control_url, x[2] AS origin_url, x[3] AS cited_on, x[4] AS ast_dist, x[5] AS function_dist, x[6] AS literal_dist, x[7] AS literals_not_in_origin,
  x[8] AS literals_not_in_control, x[9] AS n_diff_literals, diff_functions, rarest_function, rarest_probability FROM one JOIN rare USING (xref))"""


@query(f"WITH {_MATRIX} SELECT * REPLACE (round(rarest_probability, 6) AS rarest_probability) FROM matrix")
def q_outlier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _matrix(spark, sf_dir)
    return out.withColumns({"diff_functions": _list("diff_functions"), "rarest_probability": F.round("rarest_probability", 6)})


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier.matrix(hits(spark, sf_dir), _probabilities(spark, sf_dir))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).select("xref", *outlier.FEATURES)


@query()
def q_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier.outliers(_numbers(spark, sf_dir)).select("xref", "distance", "is_outlier")


# Power iteration on the covariances, then on what the first component leaves of them.
_STEP = "SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) FROM (SELECT k, list_transform(m, lambda r: list_inner_product(r, v)) AS w FROM {0}, {1} WHERE k < 400)"
_SIGNED = "list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))]))"


@query(f"""WITH RECURSIVE {_MATRIX},
f AS (SELECT xref, [ast_dist, function_dist, literal_dist, literals_not_in_origin, literals_not_in_control, coalesce(rarest_probability, 0)]::DOUBLE[] AS x FROM matrix),
c AS (SELECT i, j, covar_samp(x[i], x[j]) AS c FROM f, range(1, 7) a(i), range(1, 7) b(j) GROUP BY i, j),
m1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM c GROUP BY i)),
p1 AS (SELECT 0 AS k, [1, 1, 1, 1, 1, 1]::DOUBLE[] AS v UNION ALL {_STEP.format("p1", "m1")}),
v1 AS (SELECT v, list_inner_product(v, list_transform(m, lambda r: list_inner_product(r, v))) AS l FROM p1, m1 WHERE k = 400),
m2 AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda y, j: y - l * v[i] * v[j])) AS m FROM m1, v1),
p2 AS (SELECT 0 AS k, [1, 2, 3, 4, 5, 6]::DOUBLE[] AS v UNION ALL {_STEP.format("p2", "m2")}),
s1 AS (SELECT {_SIGNED} AS a FROM v1), s2 AS (SELECT {_SIGNED} AS b FROM p2 WHERE k = 400)
SELECT xref, round(list_inner_product(x, a), 4) AS pc1, round(list_inner_product(x, b), 4) AS pc2 FROM f, s1, s2""")
def q_principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outlier.principal_components(_numbers(spark, sf_dir))
    return found.select("xref", *(F.round(c, 4).alias(c) for c in ("pc1", "pc2")))


# --- distances -------------------------------------------------------------------------------

_CENTROIDS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
mean AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY 1, 2),
centroid AS (SELECT label, list(m ORDER BY i) AS c FROM mean GROUP BY label)"""


def _centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


@query(f"""WITH {_CENTROIDS} SELECT vec_id, round(list_distance(e, c), 6) AS dist, round(1 - list_cosine_similarity(e, c), 6) AS cosine_dist FROM v JOIN centroid USING (label)""")
def q_dense_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>")).join(_centroids(spark, sf_dir), "label")
    dist, cosine = V.vector_distance(F.col("e"), F.col("centroid")), V.cosine_distance(F.col("e"), F.col("centroid"))
    return rows.select("vec_id", F.round(dist, 6).alias("dist"), F.round(cosine, 6).alias("cosine_dist"))


@query(f"""WITH {_CENTROIDS} SELECT vec_id, arg_min(centroid.label, (list_distance(e, c), centroid.label)) AS control_id, round(min(list_distance(e, c)), 6) AS dist FROM v, centroid GROUP BY vec_id""")
def q_nearest_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match.nearest(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir).withColumnRenamed("centroid", "embedding"), "vec_id", "label", "embedding")
    return out.withColumn("dist", F.round("dist", 6))


_PAIRED = f"""{_TURNS_SQL}, pairs AS (SELECT a.conv_id, a.turn FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
paired AS (SELECT p.conv_id, p.turn, w.w, sum(CASE WHEN w.turn = p.turn THEN n ELSE 0 END) AS x, sum(CASE WHEN w.turn = p.turn + 1 THEN n ELSE 0 END) AS y
  FROM pairs p JOIN words w ON w.conv_id = p.conv_id AND w.turn IN (p.turn, p.turn + 1) GROUP BY 1, 2, 3),
stats AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE x = y) AS common, sqrt(sum((x - y) * (x - y))) AS d,
  count(*) FILTER (WHERE x = 0) AS only_y, count(*) FILTER (WHERE y = 0) AS only_x, string_agg(w, ',' ORDER BY w) FILTER (WHERE x <> y) AS diff,
  string_agg(replace(w, ',', '%2C'), ',' ORDER BY w) FILTER (WHERE x <> y) AS literals FROM paired GROUP BY 1, 2)"""
_PENALTY = "(CASE WHEN n < 15 THEN 20.0 / n ELSE 1 END)"


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("counts").alias("next"))
    return rows.join(after, ["conv_id", "turn"])


@query(f"""WITH {_PAIRED} SELECT conv_id, turn, round(d * (CASE WHEN common > 0 THEN (n - common) / common ELSE 10 END) * {_PENALTY}, 6) AS function_dist, coalesce(diff, '') AS diff_functions FROM stats""")
def q_function_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("counts"), F.col("next")
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(V.function_distance(a, b), 6).alias("function_dist"), F.array_join(V.differing_keys(a, b), ",").alias("diff_functions"))


@query(f"""WITH {_PAIRED} SELECT conv_id, turn, round(d * {_PENALTY}, 6) AS literal_dist, only_x::INT AS n_not_in_origin, only_y::INT AS n_not_in_control, coalesce(literals, '') AS diff_literals FROM stats""")
def q_literal_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    control, origin = text.truncate_literals(F.col("counts")), text.truncate_literals(F.col("next"))
    rows = _turn_pairs(spark, sf_dir).withColumn("l", V.literal_distance(control, origin))
    return rows.select("conv_id", "turn", F.round("l.dist", 6).alias("literal_dist"), "l.n_not_in_origin", "l.n_not_in_control", text.join_literals(F.col("l.diff")).alias("diff_literals"))


_WORDS = ["de", "the", "le", "und", "of", "la", "die", "en", "der", "el", "in", "les", "and", "que", "to", "et"]
_ONE = lambda side, w: f"coalesce(max(CASE WHEN w = '{w}' THEN {side} END), 0)"


@query(f"""WITH {_PAIRED}, dense AS (SELECT conv_id, turn, sqrt({" + ".join(f"power({_ONE('x', w)} - {_ONE('y', w)}, 2)" for w in _WORDS)}) AS ast,
{" + ".join(f"{_ONE('x', w)} * {float(V.AST_WEIGHTS.get(n, 1.0))}" for w, n in zip(_WORDS, V.AST_FEATURES))} AS weighted FROM paired GROUP BY 1, 2),
f AS (SELECT conv_id, turn, d * (CASE WHEN common > 0 THEN (n - common) / common ELSE 10 END) * {_PENALTY} AS fd FROM stats)
SELECT conv_id, turn, round(ast * 0.75 * fd + (ast + fd) * 0.5, 4) AS total, round((ast * 0.8 + fd * 1.5) * (fd * 1.5 + 1) + ast * 0.8 + fd * 1.5 + 1, 4) AS composite, round(weighted, 6)::DOUBLE AS weighted FROM dense JOIN f USING (conv_id, turn)""")
def q_combined_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = V.dense(F.col("counts"), _WORDS), V.dense(F.col("next"), _WORDS)
    ast, calls = V.vector_distance(a, b), V.function_distance(F.col("counts"), F.col("next"))
    weights = dict(zip(_WORDS, (V.AST_WEIGHTS.get(n, 1.0) for n in V.AST_FEATURES)))
    return _turn_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        F.round(V.total_distance(ast, calls), 4).alias("total"),
        F.round(V.composite_distance(ast, calls, F.lit(1.0)), 4).alias("composite"),
        F.round(V.total(V.dense(F.col("counts"), _WORDS, weights)), 6).alias("weighted"),
    )


# --- matching --------------------------------------------------------------------------------


def _magnitudes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n_words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("artefact_id"), F.length("text").alias("sum_ast"), n_words.alias("sum_calls"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("origin"), F.length("text").alias("sum_ast"), n_words.alias("sum_calls"))
    return docs, items


_MAGNITUDES = """m AS (SELECT doc_id AS artefact_id, length(text) AS a, length(text) - length(replace(text, ' ', '')) AS c FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS origin, length(text) AS a, length(text) - length(replace(text, ' ', '')) AS c FROM benchmark)"""


@query(f"""WITH {_MAGNITUDES} SELECT artefact_id, origin, min(s)::INT AS strategy FROM (
SELECT artefact_id, origin, 0 AS s FROM m JOIN b ON b.a >= 50 AND b.a >= m.a - 11 AND b.a < m.a + 11 UNION ALL
SELECT artefact_id, origin, 1 AS s FROM m JOIN b ON b.c >= 50 AND b.c >= m.c - 16 AND b.c < m.c + 16) GROUP BY 1, 2""")
def q_plausible_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.plausible_controls(*_magnitudes(spark, sf_dir), max_distance=20.0)


@query(f"""WITH {_MAGNITUDES} SELECT artefact_id, origin, 0 AS strategy FROM m JOIN b ON b.a >= 50 AND b.a >= m.a - 11 AND b.a < m.a + 11""")
def q_plausible_ast_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.plausible_controls(*_magnitudes(spark, sf_dir), max_distance=20.0, strategies=("ast",))


_REASON = """CASE WHEN (ast_dist < 10 OR (ast_dist < 20 AND greatest(len(diff_functions) - 1, 0) < 10)) AND ast_dist > 0 AND function_dist > 0 THEN 'original_criteria'
WHEN literal_dist < 0 THEN 'bad_literal_dist'
WHEN (ast_dist * 0.8 + function_dist * 1.5) * (function_dist * 1.5 + literal_dist) + ast_dist * 0.8 + function_dist * 1.5 + literal_dist <= 100 THEN 'dist_lt_100.0'
WHEN least(ast_dist, function_dist, literal_dist) * (ast_dist + function_dist + literal_dist - least(ast_dist, function_dist, literal_dist) - greatest(ast_dist, function_dist, literal_dist)) < 25 THEN 'good_two_smallest_distances'
ELSE 'failed_every_test' END"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.classify(hits(spark, sf_dir).withColumn("diff_functions", F.array_join("diff_functions", " ")), 100.0)


@query(f"""WITH {HITS_SQL}, j AS (SELECT *, {_REASON} AS reason FROM hits)
SELECT xref, control_url, origin_url, ast_dist, function_dist, literal_dist, reason NOT IN ('bad_literal_dist', 'failed_every_test') AS ok, reason FROM j""")
def q_good_hit_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("xref", "control_url", "origin_url", "ast_dist", "function_dist", "literal_dist", "ok", "reason")


@query(f"WITH {HITS_SQL}, j AS (SELECT {_REASON} AS reason FROM hits) SELECT reason, count(*) AS n FROM j GROUP BY reason")
def q_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {HITS_SQL}, j AS (SELECT *, {_REASON} AS reason FROM hits)
SELECT xref, control_url, family AS control_family, split_part(split_part(origin_url, '//', 2), '/', 1) AS origin_host, split_part(split_part(cited_on, '//', 2), '/', 1) AS cited_on_host, 443 AS origin_port,
'/' || split_part(split_part(cited_on, '//', 2), '/', 2) AS cited_on_path, reason, len(diff_functions)::INT AS n_functions
FROM j WHERE reason NOT IN ('bad_literal_dist', 'failed_every_test') AND control_url IN (SELECT origin FROM controls WHERE NOT do_not_load)""")
def q_publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).drop("cited_on_host", "cited_on_path").withColumn("diff_functions", F.array_join("diff_functions", " "))
    good, _ = match.publish(rows, controls(spark, sf_dir).where("not do_not_load"), 100.0)
    return good.select("xref", "control_url", "control_family", "origin_host", "cited_on_host", "origin_port", "cited_on_path", "reason", F.size("diff_functions").alias("n_functions"))


# --- artefacts -------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, strlen(text)::INT AS size_bytes, doc_id <> min(doc_id) OVER (PARTITION BY text) AS was_cached FROM documents WHERE text IS NOT NULL""")
def q_artefact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artefact.with_hashes(table(spark, sf_dir, "documents").where("text is not null"), "text")
    return artefact.deduplicated(rows.select("doc_id", *artefact.KEY), ["doc_id"]).select("doc_id", *artefact.KEY, "was_cached")


@query("""SELECT source AS url, arg_max(sha256(text), doc_id) AS sha256, max(doc_id)::VARCHAR AS url_id FROM documents WHERE text IS NOT NULL GROUP BY source""")
def q_url_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artefact.with_hashes(table(spark, sf_dir, "documents").where("text is not null"), "text").withColumn("js_id", artefact.content_id())
    url_id = F.col("doc_id").cast("string").alias("url_id")
    urls, links = rows.select(url_id, F.col("source").alias("url"), F.col("doc_id").alias("last_visited")), rows.select(url_id, F.col("js_id").alias("script"))
    return artefact.url_history(urls, links, rows.select("js_id", "sha256").distinct())


@query("""SELECT DISTINCT k AS key FROM (SELECT unnest(json_keys(props)) AS k FROM events)""")
def q_key_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artefact.keys(table(spark, sf_dir, "events").select(F.from_json("props", "map<string,int>").alias("counts")), "counts")


@query(f"WITH {_TURNS_SQL} SELECT w AS key, count(*) AS n_rows FROM words WHERE w NOT IN ('the', 'de') GROUP BY w HAVING count(*) >= 20")
def q_doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artefact.document_frequency(turns(spark, sf_dir), "counts", 20, ["the", "de"])


@query(f"""WITH {_TURNS_SQL}, t AS (SELECT text, conv_id * 1000 + turn AS seq FROM turns), f AS (SELECT sha256(text) AS sha256, count(*) AS n, min(seq) AS seq FROM t GROUP BY 1)
SELECT sha256, f.n, seq::VARCHAR AS first_url, {", ".join(f"coalesce(max(CASE WHEN w = '{w}' THEN words.n END), 0)::INT AS {w}_" for w in _WORDS[:8])}
FROM f LEFT JOIN words ON conv_id * 1000 + turn = seq GROUP BY 1, 2, 3""")
def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = turns(spark, sf_dir).join(texts, ["conv_id", "turn"]).withColumns({"sha256": F.sha2("text", 256), "when": F.col("conv_id") * 1000 + F.col("turn")})
    out = artefact.feature_matrix(rows.withColumn("url", F.col("when").cast("string")), _WORDS[:8], "counts")
    return out.withColumnsRenamed({w: f"{w}_" for w in _WORDS[:8]})


@query("""SELECT b.item_id, strlen(b.text)::INT AS size_bytes FROM benchmark b WHERE strlen(text) >= 200 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)""")
def q_accepted_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = artefact.with_hashes(table(spark, sf_dir, "benchmark"), "text")
    known = artefact.with_hashes(table(spark, sf_dir, "documents").where("text is not null"), "text")
    return artefact.accepted_controls(new, known, 200).select("item_id", "size_bytes")


@query(r"""WITH w AS (SELECT item_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM benchmark)
SELECT 'https://controls.example/' || item_id AS origin, (length(text) - length(replace(text, ' ', '')) + length(text) - length(replace(text, '.', '')) + length(text) - length(replace(text, ',', '')))::BIGINT AS sum_of_ast_features,
n::BIGINT AS sum_of_functions, n::BIGINT AS sum_of_literals FROM benchmark JOIN w USING (item_id)""")
def q_control_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artefact.control_summary(script_tables(spark, sf_dir)[1]).drop("last_updated")


@query("""SELECT doc_id, gen AS generation FROM (SELECT doc_id, 0 AS gen FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1 FROM labels UNION ALL SELECT doc_id, 2 FROM documents) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY gen) = 1""")
def q_first_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels").select("doc_id", "toxic"), table(spark, sf_dir, "documents").select("doc_id")
    return artefact.first_found([labels.where("toxic = 1").select("doc_id"), labels.select("doc_id"), docs], "doc_id").select("doc_id", "generation")


# --- urls, pages and the crawl ---------------------------------------------------------------


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS page_host, length(regexp_extract(url, '\?([^#]*)', 1)) > 0 AS page_has_query, CASE WHEN starts_with(url, 'https:') THEN 443 ELSE 80 END AS page_port,
regexp_extract(url, '^([a-z]+):', 1) AS page_scheme, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS page_path FROM pages""")
def q_url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *url.url_fields(F.col("url"), "page"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, length(regexp_extract(url, '\?([^#]*)', 1)) AS q FROM pages)
SELECT page_id, (1 + CASE WHEN path = '/' THEN 0 ELSE least(length(path) - length(replace(path, '/', '')), 3) END + CASE WHEN regexp_matches(lower(path), '\.(mp3|avi|pdf|png|vob|mpeg|mpg|mp4|jpeg|jpg)$') THEN 2 ELSE 0 END
+ CASE WHEN q >= 20 THEN 2 WHEN q > 0 THEN 1 ELSE 0 END + CASE WHEN length(url) > 150 THEN 2 WHEN length(url) > 80 THEN 1 ELSE 0 END)::INT AS priority FROM p""")
def q_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url.priority(F.col("url")).alias("priority"))


@query(r"""SELECT p_partkey, lower(replace(p_name, ' ', '-')) AS subfamily, lower(p_type) || '-tracker' AS plain FROM part""")
def q_subfamily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))
    first = F.concat(F.lit("https://cdn.example/lib/1.0/"), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".min.js"))
    second = F.concat(F.lit("https://cdn.example/lib/"), F.col("p_type"), F.lit("__tracker-dev.js"))
    return rows.select("p_partkey", url.subfamily(first).alias("subfamily"), url.subfamily(second).alias("plain"))


_LINKS = r"""p AS (SELECT page_id, url, html, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages),
l AS (SELECT DISTINCT page_id, host, CASE WHEN starts_with(h, '/') THEN scheme || '://' || host || h ELSE h END AS link
  FROM (SELECT page_id, scheme, host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS h FROM p)),
c AS (SELECT p.page_id, p.host, count(link) FILTER (WHERE NOT contains(link, l.host)) AS n_external, count(link) FILTER (WHERE contains(link, l.host)) AS n_internal,
  coalesce(string_agg(link, ' ' ORDER BY link), '') AS links FROM p LEFT JOIN l USING (page_id) GROUP BY 1, 2)"""


@query(f"WITH {_LINKS} SELECT * FROM c")
def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = crawl.page_links(table(spark, sf_dir, "pages"))
    links = F.array_join(F.array_sort(F.concat("external", "internal")), " ")
    return out.select("page_id", "host", F.size("external").cast("long").alias("n_external"), F.size("internal").cast("long").alias("n_internal"), links.alias("links"))


@query(r"""WITH s AS (SELECT url, list_filter(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda x: trim(x) <> '') AS l FROM pages)
SELECT url, (generate_subscripts(l, 1) - 1)::INT AS position, unnest(l) AS code, sha256(unnest(l)) AS sha256, md5(unnest(l)) AS md5, strlen(unnest(l))::INT AS size_bytes FROM s""")
def q_inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.inline_scripts(table(spark, sf_dir, "pages"))


# For scripts of declarations, assignments, calls, strings and numbers, as the pages have.
@query(r"""WITH s AS (SELECT url, list_filter(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda x: trim(x) <> '') AS l FROM pages),
c AS (SELECT url, (generate_subscripts(l, 1) - 1)::INT AS position, unnest(l) AS code FROM s), t AS (SELECT *, regexp_replace(code, '"[^"]*"', ' ', 'g') AS rest FROM c),
n AS (SELECT url, position, len(regexp_extract_all(code, '"[^"]*"')) AS strings, len(regexp_extract_all(rest, '\b\d+\b')) AS numbers, len(list_filter(regexp_extract_all(rest, '[A-Za-z_]\w*'), lambda x: x <> 'var')) AS names,
  len(regexp_extract_all(rest, '\bvar\b')) AS vars, len(regexp_extract_all(rest, '=')) AS assigned, len(regexp_extract_all(rest, '[A-Za-z_]\w*\(')) AS calls, len(regexp_extract_all(rest, '\);')) AS closed FROM t)
SELECT url, position, false AS failed, (1 + strings + numbers + names + vars + assigned + calls + closed)::BIGINT AS statements_by_count, calls::BIGINT AS calls_by_count, (strings + numbers)::BIGINT AS literals_by_count FROM n""".replace("\\\\", "\\"))
def q_script_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q_inline_scripts(spark, sf_dir).select("url", "position", analysed(F.col("code").cast("binary")).alias("a"))
    return rows.select("url", "position", "a.failed", *(V.map_total(F.coalesce(f"a.{c}", F.from_json(F.lit("{}"), "map<string,int>"))).alias(c) for c in ("statements_by_count", "calls_by_count", "literals_by_count")))


@query("SELECT user_id, count(*) AS n_pages FROM events GROUP BY user_id HAVING count(*) > 65")
def q_host_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.host_page_counts(table(spark, sf_dir, "events"), "user_id", 65)


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day) AS n_pages FROM d)
SELECT user_id, max(n_pages)::BIGINT AS n_pages FROM r WHERE n_pages >= 60 GROUP BY user_id""")
def q_overrepresented(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    running = days.select("user_id", "day", F.sum("n").over(Window.partitionBy("user_id").orderBy("day")).alias("n_pages"))
    return crawl.over_represented(running, "user_id", "n_pages", None, 60)


@query("SELECT user_id, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def q_recent_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return crawl.recent_sites(per.where("event_type in ('click', 'view')"), per.where("event_type not in ('click', 'view')"), host="user_id")


@query("""SELECT event_id, ts::DATE AS day, user_id, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts, event_id) AS rank_in_batch FROM events QUALIFY rank_in_batch <= 2""")
def q_congested_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return crawl.congested(rows, "day", "user_id", ["ts", "event_id"], 2).select("event_id", "day", "user_id", F.col("rank_in_batch").cast("long").alias("rank_in_batch"))


@query("""SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_recent FROM events""")
def q_running_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    penalty = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return crawl.running_pages(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], penalty, F.to_date("ts")).select("event_id", F.col("n_recent").cast("long").alias("n_recent"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"


@query(rf"""WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rk, count(*) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_recent FROM h),
j AS (SELECT CASE WHEN starts_with(host, 'm.') THEN 'blacklisted' WHEN n_recent > 20 THEN 'recently_crawled' WHEN rk > 10 THEN 'congested_batch' WHEN starts_with(host, 'blog.') THEN 'long_term_banned'
  WHEN 1 + least(3, 2) + CASE WHEN contains(url, '?') THEN CASE WHEN length(regexp_extract(url, '\?([^#]*)', 1)) >= 20 THEN 2 WHEN length(regexp_extract(url, '\?([^#]*)', 1)) > 0 THEN 1 ELSE 0 END ELSE 0 END > 4 THEN 'unsuitable_priority'
  WHEN NOT (host LIKE '%.org') THEN 'outside_au' END AS reject_reason FROM k)
SELECT reject_reason, count(*) AS n FROM (SELECT CASE WHEN reject_reason IN ('unsuitable_priority') THEN 'unsuitable_priority' ELSE reject_reason END AS reject_reason FROM j) GROUP BY 1""")
def q_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    u, host = F.col("url"), F.col("host")
    rows = table(spark, sf_dir, "pages").withColumn("host", url.hostname(u))
    # paths as deep as a language and a number
    rows = rows.withColumn("priority", url.priority(F.regexp_replace(u, r"^([a-z]+://[^/?#]*)[^?#]*", "$1/a/b")))
    rows = crawl.running_pages(rows, "host", ["page_id"]).withColumns({
        "rank_in_batch": F.row_number().over(Window.partitionBy("host").orderBy("page_id")), "is_blacklisted": host.startswith("m."),
        "n_site_cache": F.lit(0), "is_banned": host.startswith("blog."), "is_outside": ~host.endswith(".org")})
    return crawl.reject_counts(crawl.suitability(rows, crawl.standard_criteria()))


@query(f"SELECT page_id, {_HOST} AS host FROM pages WHERE NOT ({_HOST} LIKE '%.com' OR {_HOST} LIKE '%.net')")
def q_foreign_tld(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://self.example.com/"), F.col("page_id")).alias("url"), F.concat(F.lit("  "), F.col("url"), F.lit(" ")).alias("scripts"))
    found = crawl.foreign_scripts(rows, "url", "scripts", (".com", ".net"))
    return found.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), "host")


@query("""SELECT DISTINCT 'https://u' || user_id || '.example/' AS url FROM events WHERE event_type = 'error' AND (400 + value::INT % 200 = 403 OR 400 + value::INT % 200 >= 500)""")
def q_retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    return crawl.retry_candidates(rows.select(F.concat(F.lit("https://u"), "user_id", F.lit(".example/")).alias("url"), (F.lit(400) + F.rint("value").cast("int") % 200).alias("http_status")))


@query("SELECT page_id, strlen(html)::INT AS size_bytes FROM pages WHERE strlen(html) >= 1500")
def q_javascript_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").alias("size_bytes"), F.lit(None).cast("string").alias("a"), F.lit("text/javascript").alias("b"))
    return rows.where(text.javascript_only(F.col("a"), F.col("size_bytes"), F.col("b"))).select("page_id", "size_bytes")


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), ip AS (SELECT host, '10.' || (length(host) % 256) || '.' || (ascii(host) % 256) || '.7' AS ip FROM h),
n AS (SELECT *, 10::BIGINT * 16777216 + (length(host) % 256) * 65536 + (ascii(host) % 256) * 256 + 7 AS num FROM ip), r AS (SELECT 167772160 + 65536 * n_nationkey AS lo, 167772160 + 65536 * n_nationkey + 65535 AS hi, n_name FROM nation)
SELECT ip AS host, num AS ip, min(n_name) AS country FROM (SELECT DISTINCT ip, num FROM n) JOIN r ON num BETWEEN lo AND hi GROUP BY 1, 2""")
def q_geo_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = url.hostname(F.col("url"))
    ips = table(spark, sf_dir, "pages").select(F.concat_ws(".", F.lit("10"), (F.length(host) % 256).cast("string"), (F.ascii(host) % 256).cast("string"), F.lit("7")).alias("host")).distinct()
    first = F.lit(167772160) + F.col("n_nationkey").cast("long") * 65536
    return crawl.geolocated(ips, table(spark, sf_dir, "nation").select(first.alias("start"), (first + 65535).alias("stop"), F.col("n_name").alias("country")))


@query("""SELECT 'part' || p_size AS name, '1.' || p_brand AS version, replace(p_name, ' ', '/') || '.min.js' AS file FROM part WHERE contains(p_brand, '#1')""")
def q_library_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_size").alias("name"), F.concat(F.lit("1."), "p_brand").alias("version"), F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".min.js")).alias("file"))
    assets = rows.groupBy("name", "version").agg(F.collect_list("file").alias("files")).groupBy("name").agg(F.collect_list(F.struct("version", "files")).alias("assets"))
    return files.library_catalog(assets, "https://cdn.example/ajax/libs", "min", "#1").select("name", "version", "file")


@query("""WITH l AS (SELECT event_id, '[2024-01-01 00:00:00] ' || CASE event_type WHEN 'click' THEN '[link redirection] https://u' || user_id || '.example/' WHEN 'view' THEN '[MongoDB] Analysis ID: ' || event_id
WHEN 'signup' THEN '[script src redirection] https://a.example/' || user_id || ' -> https://b.example/' || event_id WHEN 'error' THEN '[HTTP] URL: https://h.example/' || event_id ELSE '[anchor] https://c.example/' || user_id END AS line FROM events)
SELECT event_id, regexp_extract(line, 'Analysis ID: (\\S+)', 1) AS analysis_id, regexp_extract(line, 'src redirection\\] (\\S+) ->', 1) AS redirected_from, regexp_extract(line, '-> (\\S+)', 1) AS redirected_to,
regexp_extract(line, '\\[link[^\\]]*\\] (\\S+)', 1) AS link, regexp_extract(line, 'URL: (\\S+)', 1) AS http, regexp_extract(line, '\\[anchor\\] (\\S+)', 1) AS anchor FROM l""".replace("\\\\", "\\"))
def q_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user, event = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    said = (
        F.when(kind == "click", F.concat(F.lit("[link redirection] https://u"), user, F.lit(".example/")))
        .when(kind == "view", F.concat(F.lit("[MongoDB] Analysis ID: "), event))
        .when(kind == "signup", F.concat(F.lit("[script src redirection] https://a.example/"), user, F.lit(" -> https://b.example/"), event))
        .when(kind == "error", F.concat(F.lit("[HTTP] URL: https://h.example/"), event))
        .otherwise(F.concat(F.lit("[anchor] https://c.example/"), user))
    )
    return table(spark, sf_dir, "events").select("event_id", *text.log_fields(F.concat(F.lit("[2024-01-01 00:00:00] "), said)))


# --- searches --------------------------------------------------------------------------------

_HIT = ["xref", "control_url", "origin_url", "cited_on_host", "ast_dist", "function_dist", "literal_dist"]
_HIT_SQL = ", ".join(_HIT)


@query(f"WITH {HITS_SQL} SELECT {_HIT_SQL} FROM hits WHERE contains(lower(cited_on_host), 's1')")
def q_search_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_host(hits(spark, sf_dir), "S1").select(_HIT)


@query(f"WITH {HITS_SQL} SELECT {_HIT_SQL} FROM hits WHERE control_url = 'https://controls.example/17'")
def q_search_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_control(hits(spark, sf_dir), "https://controls.example/17", False).select(_HIT)


@query(f"WITH {HITS_SQL} SELECT {_HIT_SQL} FROM hits WHERE ast_dist >= 2 AND ast_dist < 20 AND function_dist >= 0 AND function_dist < 5 AND literal_dist >= 3")
def q_search_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_distance(hits(spark, sf_dir), (2, 20), (0, 5), (3, None)).select(_HIT)


@query(f"WITH {HITS_SQL} SELECT {_HIT_SQL} FROM hits WHERE NOT sha256_matched AND len(diff_functions) > 0 AND created_at >= TIMESTAMP '2001-06-30' - INTERVAL 200 DAY")
def q_search_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent(hits(spark, sf_dir), 200, now=F.lit("2001-06-30").cast("timestamp_ntz"), exclude_hash_matches=True, exclude_blank_functions=True).select(_HIT)


@query(f"WITH {HITS_SQL} SELECT {_HIT_SQL} FROM hits WHERE list_contains(diff_functions, 'PROMO')")
def q_search_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_function(hits(spark, sf_dir), "PROMO").select(_HIT)


@query(f"WITH {HITS_SQL} SELECT {_HIT_SQL} FROM hits WHERE family = 'Brand#3' ORDER BY control_url, function_dist DESC, {_HIT_SQL} LIMIT 100 OFFSET 100")
def q_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).where("family = 'Brand#3'").select(_HIT)
    return search.page(rows, 2, [F.col("control_url"), F.desc("function_dist"), *_HIT])


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def q_admin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.admin_list(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "RING", ["p_name", "p_type"], ["p_brand", "p_partkey"])


# --- tables and topics -----------------------------------------------------------------------


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def q_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return maintenance.upsert(rows.where("event_id < 500"), rows.where("event_id >= 500"), ["user_id"], ["ts"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size <> 1")
def q_purge_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    purged = parts.where("p_size = 1").select(F.col("p_partkey").alias("origin"))
    return maintenance.purge({"part": (parts, "p_partkey")}, purged, dry_run=False)["part"].select("p_partkey", "p_name")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'fresh' ELSE n_name END AS n_name, n_regionkey FROM nation")
def q_refresh_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return maintenance.refreshed(rows, rows.where("n_regionkey = 1").withColumn("n_name", F.lit("fresh")), "n_regionkey").select("n_nationkey", "n_name", "n_regionkey")


@query(f"WITH {HITS_SQL} SELECT count(*) AS n FROM hits WHERE control_url <> 'https://controls.example/17'")
def q_delete_control_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.without_control_hits(hits(spark, sf_dir), "https://controls.example/17").agg(F.count("*").alias("n"))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def q_topic_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return rows.select("event_id", topics.encode("event_id", "user_id", "event_type").alias("value"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def q_topic_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", topics.decode(F.col("props"), "k int")["k"].alias("k"))


@query("SELECT key, key || ':' || n AS value FROM (SELECT CASE WHEN starts_with(k, '$') OR k = '_id' THEN 'F' || k ELSE k END AS key, n FROM (SELECT '$' || event_type AS k, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT '_id', 0 UNION ALL SELECT 'plain', 1))")
def q_safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").cast("int").alias("n"))
    one = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("$"), "event_type"), "n"))).alias("m"))
    one = one.select(F.map_concat("m", F.create_map(F.lit("_id"), F.lit(0), F.lit("plain"), F.lit(1))).alias("m"))
    return one.select(F.explode(text.safe_keys(F.col("m"))).alias("key", "n")).select("key", F.concat_ws(":", "key", "n").alias("value"))


@query("SELECT event_id, CASE WHEN length(line) < 300 THEN line ELSE substr(line, 1, 300) || '...' END AS reason FROM (SELECT event_id, repeat(event_type || ' ', (value::INT % 90)) AS line FROM events)")
def q_failure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("repeat(concat(event_type, ' '), cast(rint(value) as int) % 90)")
    return table(spark, sf_dir, "events").select("event_id", text.shortened(line).alias("reason"))


@query(f"WITH {_MAGNITUDES} SELECT artefact_id AS k FROM m UNION SELECT origin FROM b")
def q_union_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _magnitudes(spark, sf_dir)
    return a.select(F.col("artefact_id").alias("k")).unionByName(b.select(F.col("origin").alias("k"))).distinct()


@query(f"WITH {_PAIRED} SELECT conv_id, turn, n AS n_keys, common AS n_equal FROM stats")
def q_map_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("counts"), F.col("next")
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.size(keys).cast("long").alias("n_keys"), (F.size(keys) - F.size(V.differing_keys(a, b))).cast("long").alias("n_equal"))


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 300 AS batch FROM events")
def q_count_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.count_batches(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], 300).select("event_id", "batch")


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


# --- streams ---------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_first_seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(spark, sf_dir, lambda s: pipelines.first_seen(s, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "append")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collected(spark, sf_dir, lambda s: pipelines.counts(s, "event_type"), "complete")


@query("SELECT user_id AS host, sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END)::BIGINT AS n FROM events GROUP BY user_id")
def q_host_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(s: DataFrame) -> DataFrame:
        rows = s.select(F.col("user_id").alias("host"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("penalty"))
        return pipelines.host_penalties(rows.withColumn("host", F.col("host").cast("string")))

    out = collected(spark, sf_dir, run, "update")
    return out.where("not evicted").groupBy("host").agg(F.max("n").alias("n")).withColumn("host", F.col("host").cast("long"))


# --- further uses of the same tables ----------------------------------------------------------


@query("""SELECT page_id, lower(regexp_extract(url, '^([a-z]+):', 1)) = 'https' AS ok, CASE WHEN page_id % 7 = 0 THEN 'exception' WHEN page_id % 5 = 0 THEN 'failed' ELSE 'canonical' END AS route FROM pages""")
def q_status_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select("page_id", (url.scheme(F.col("url")) == "https").alias("ok"), F.when(p % 7 == 0, "timeout").alias("error"), F.when(p % 5 == 0, 404).otherwise(301).alias("status"))
    return crawl.routed(rows).select("page_id", "ok", "route")


@query("SELECT p_partkey, lower(p_type) || '-' || lower(replace(p_brand, '#', '-')) AS subfamily FROM part")
def q_subfamily_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.concat(F.lit("https://cdn.example/x/"), F.col("p_type"), F.lit("."), F.col("p_brand"), F.lit(".js"))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", origin.alias("origin"), F.lit("old").alias("subfamily")))
    return maintenance.with_subfamilies(rows, only_changed=True).select("p_partkey", "subfamily")


@query(f"""WITH {_PAIRED}, d AS (SELECT conv_id, turn, string_agg(w, ',' ORDER BY abs(x - y) DESC, w) FILTER (WHERE x <> y) AS ranked, sum(x) AS a, sum(y) AS b FROM paired GROUP BY 1, 2)
SELECT conv_id || '/' || turn AS k, a::BIGINT AS a_magnitude, b::BIGINT AS b_magnitude, coalesce(ranked, '') AS diff_features, round(d * (CASE WHEN common > 0 THEN (n - common) / common ELSE 10 END) * {_PENALTY}, 6) AS function_dist FROM d JOIN stats USING (conv_id, turn)""")
def q_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turn_pairs(spark, sf_dir).withColumn("k", F.concat_ws("/", "conv_id", "turn"))
    maps = lambda c: [F.col(c).alias(n) for n in ("statements_by_count", "calls_by_count", "literals_by_count")]
    out = report.pairwise(rows.select("k", *maps("counts")), rows.select("k", *maps("next")), "k")
    return out.select("k", "a_magnitude", "b_magnitude", _list("diff_features"), F.round("function_dist", 6).alias("function_dist"))
