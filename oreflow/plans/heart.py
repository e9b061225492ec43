"""The search for the best control, its SQL as a fold over ordered candidates, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maintenance, match
from .analogue import script_tables
from .catalogue import _TURNS_SQL
from .registry import query

MAX_DISTANCE = 20_000.0

_SHAPE = "length(text) - length(replace(text, ' ', '')) AS s, length(text) - length(replace(text, '.', '')) AS b, length(text) - length(replace(text, ',', '')) AS e"
#: Spark's rounding of halves is the same; infinite values stay.
_ROUND = "CASE WHEN isinf({0}) THEN {0} ELSE round({0}, 6) END AS {0}"

# Written from the definition of the search: candidates in the order (strategy, origin), a state of best and second,
# and an end at a distance near zero.
_SEARCH = f"""{_TURNS_SQL},
a AS (SELECT conv_id || '/' || turn AS id, text, {_SHAPE} FROM turns),
aw AS (SELECT conv_id || '/' || turn AS id, w, n FROM words),
bt AS (SELECT 'https://controls.example/' || item_id AS origin, min(text) AS text FROM benchmark GROUP BY item_id),
bs AS (SELECT origin, text, {_SHAPE} FROM bt),
bw AS (SELECT origin, w, count(*) AS n FROM (SELECT origin, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM bt) WHERE w <> '' GROUP BY 1, 2),
an AS (SELECT a.*, coalesce(k, 0) AS k, coalesce(calls, 0) AS calls, coalesce(sq, 0) AS sq FROM a LEFT JOIN (SELECT id, count(*) AS k, sum(n) AS calls, sum(n * n) AS sq FROM aw GROUP BY id) USING (id)),
bn AS (SELECT bs.*, coalesce(k, 0) AS k, coalesce(calls, 0) AS calls, coalesce(sq, 0) AS sq FROM bs LEFT JOIN (SELECT origin, count(*) AS k, sum(n) AS calls, sum(n * n) AS sq FROM bw GROUP BY origin) USING (origin)),
near AS (SELECT an.id, bn.origin, min(st) AS strategy FROM an JOIN (SELECT *, unnest([0, 1]) AS st FROM bn) bn ON
  (st = 0 AND bn.s + bn.b + bn.e >= 50 AND bn.s + bn.b + bn.e >= an.s + an.b + an.e - 0.55 * {MAX_DISTANCE} AND bn.s + bn.b + bn.e < an.s + an.b + an.e + 0.55 * {MAX_DISTANCE})
  OR (st = 1 AND bn.calls >= 50 AND bn.calls >= an.calls - 0.8 * {MAX_DISTANCE} AND bn.calls < an.calls + 0.8 * {MAX_DISTANCE}) GROUP BY 1, 2),
both_words AS (SELECT id, origin, count(*) AS shared, count(*) FILTER (WHERE aw.n = bw.n) AS same, sum(aw.n * bw.n) AS xy FROM aw JOIN bw USING (w) GROUP BY 1, 2),
pair AS (SELECT id, origin, strategy, an.text = bn.text AS same_text, an.k + bn.k - coalesce(shared, 0) AS n, coalesce(same, 0) AS same, sqrt(greatest(an.sq + bn.sq - 2 * coalesce(xy, 0), 0)) AS gap,
  sqrt((an.s - bn.s) * (an.s - bn.s) + (an.b - bn.b) * (an.b - bn.b) + (an.e - bn.e) * (an.e - bn.e)) AS ast FROM near JOIN an USING (id) JOIN bn USING (origin) LEFT JOIN both_words USING (id, origin)),
dist AS (SELECT *, CASE WHEN n = 0 THEN 'infinity'::DOUBLE ELSE gap * CASE WHEN same > 0 THEN (n - same) / same ELSE 10 END * CASE WHEN n < 15 THEN 20.0 / n ELSE 1 END END AS fd, gap * CASE WHEN n < 15 THEN 20.0 / greatest(n, 1) ELSE 1 END AS ld FROM pair),
cand AS (SELECT *, ast * 0.75 * fd + (ast + fd) * 0.5 AS total, (ast * 0.8 + fd * 1.5) * (fd * 1.5) + ast * 0.8 + fd * 1.5 AS comp FROM dist),
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY strategy, origin) AS k FROM cand WHERE total <= {MAX_DISTANCE}),
fold AS (
  SELECT id, 0 AS k, '' AS bo, 'infinity'::DOUBLE AS bt, 'infinity'::DOUBLE AS bc, false AS matched, false AS done, NULL::VARCHAR AS so, NULL::DOUBLE AS sc FROM an
  UNION ALL
  SELECT id, k, CASE WHEN take THEN origin ELSE bo END, CASE WHEN take THEN total ELSE bt END, CASE WHEN take THEN comp ELSE bc END, CASE WHEN take THEN total < 1e-5 AND same_text ELSE matched END, done OR (take AND total < 1e-5),
    CASE WHEN take THEN bo WHEN second THEN origin ELSE so END, CASE WHEN take THEN bc WHEN second THEN comp ELSE sc END
  FROM (SELECT f.id, o.k, bo, bt, bc, matched, done, so, sc, origin, total, comp, same_text, NOT done AND total < bt AND NOT bc < comp AS take, NOT done AND total < bt AND bc < comp AND (so IS NULL OR sc > comp) AS second
        FROM fold f JOIN ordered o ON o.id = f.id AND o.k = f.k + 1)),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1),
ranked AS (SELECT id, 0 AS rank, bo AS origin, matched FROM last UNION ALL SELECT id, 1, so, false FROM last WHERE so IS NOT NULL),
full_hits AS (SELECT r.id AS artefact_id, rank, r.origin AS control_url, substr(sha256('https://speech.example/' || r.id || chr(0) || r.origin), 1, 24) AS xref, matched AS sha256_matched,
  coalesce(c.ast, 'infinity'::DOUBLE) AS ast_dist, coalesce(c.fd, 'infinity'::DOUBLE) AS function_dist, coalesce(c.ld, -1.0) AS literal_dist FROM ranked r LEFT JOIN cand c ON c.id = r.id AND c.origin = r.origin),
judged AS (SELECT *, (ast_dist * 0.8 + function_dist * 1.5) * (function_dist * 1.5 + greatest(literal_dist, 0)) + ast_dist * 0.8 + function_dist * 1.5 + greatest(literal_dist, 0) AS composite FROM full_hits),
emitted AS (SELECT *, max(composite) FILTER (WHERE rank = 0) OVER (PARTITION BY artefact_id) AS best FROM judged QUALIFY rank = 0 OR (control_url <> '' AND composite <= best AND composite < 50))"""


_OUT = ["artefact_id", "rank", "control_url", "xref", "sha256_matched"]
_OUT_SQL = ", ".join([*_OUT, *(_ROUND.format(c) for c in ("ast_dist", "function_dist", "literal_dist", "composite"))])


def _shown(found: DataFrame) -> DataFrame:
    return found.select(*_OUT, *(F.round(c, 6).alias(c) for c in ("ast_dist", "function_dist", "literal_dist", "composite")))


@query(f"WITH RECURSIVE {_SEARCH} SELECT {_OUT_SQL} FROM emitted")
def q_best_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(match.evaluate(*script_tables(spark, sf_dir), max_distance=MAX_DISTANCE))


@query(f"WITH RECURSIVE {_SEARCH} SELECT {_OUT_SQL} FROM emitted WHERE artefact_id IN (SELECT conv_id || '/' || turn FROM turns WHERE conv_id % 3 = 0)")
def q_recalculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The artefacts that were vetted against one control, evaluated anew; conversations divisible by three play them."""
    a, b = script_tables(spark, sf_dir)
    vetted = a.select(F.when(F.split("artefact_id", "/")[0].cast("long") % 3 == 0, "https://controls.example/1").otherwise("https://controls.example/2").alias("control_url"), F.col("js_id").alias("origin_js_id"))
    return _shown(maintenance.recalculated(vetted, a, b, "https://controls.example/1", MAX_DISTANCE))


@query(f"""WITH RECURSIVE {_SEARCH},
differing AS (SELECT e.artefact_id, e.rank, count(*) AS n_differing FROM emitted e JOIN (
    SELECT id, origin, w FROM (SELECT e.artefact_id AS id, e.control_url AS origin, aw.w, aw.n FROM emitted e JOIN aw ON aw.id = e.artefact_id) x FULL JOIN (SELECT e.artefact_id AS id, e.control_url AS origin, bw.w, bw.n FROM emitted e JOIN bw ON bw.origin = e.control_url) y USING (id, origin, w)
    WHERE x.n IS DISTINCT FROM y.n) d ON d.id = e.artefact_id AND d.origin = e.control_url WHERE e.control_url <> '' GROUP BY 1, 2),
r AS (SELECT e.*, greatest(coalesce(n_differing, 0) - 1, 0) AS n_diff, least(ast_dist, function_dist, literal_dist) AS lo, greatest(ast_dist, function_dist, literal_dist) AS hi,
  (ast_dist * 0.8 + function_dist * 1.5) * (function_dist * 1.5 + literal_dist) + ast_dist * 0.8 + function_dist * 1.5 + literal_dist AS whole FROM emitted e LEFT JOIN differing USING (artefact_id, rank)),
v AS (SELECT *, CASE WHEN (ast_dist < 10 OR (ast_dist < 20 AND n_diff < 10)) AND ast_dist > 0 AND function_dist > 0 THEN 'original_criteria' WHEN literal_dist < 0 THEN 'bad_literal_dist'
  WHEN whole <= {MAX_DISTANCE} THEN 'dist_lt_{MAX_DISTANCE}' WHEN lo * (ast_dist + function_dist + literal_dist - lo - hi) < 25 THEN 'good_two_smallest_distances' ELSE 'failed_every_test' END AS reason FROM r)
SELECT artefact_id, control_url, 'speech.example' AS origin_host, 'speech.example' AS cited_on_host, 443 AS cited_on_port, reason NOT IN ('bad_literal_dist', 'failed_every_test') AS ok, reason,
  CASE WHEN reason NOT IN ('bad_literal_dist', 'failed_every_test') THEN 'benchmark' END AS control_family FROM v WHERE reason IN ('bad_literal_dist', 'failed_every_test') OR control_url <> ''""")
def q_published_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = script_tables(spark, sf_dir)
    good, bad = match.publish(match.evaluate(a, b, max_distance=MAX_DISTANCE), b, MAX_DISTANCE)
    columns = ["artefact_id", "control_url", "origin_host", "cited_on_host", "cited_on_port", "ok", "reason"]
    return good.select(*columns, "control_family").unionByName(bad.select(*columns), allowMissingColumns=True)
