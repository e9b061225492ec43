"""Artefact to best control: candidates by magnitude, an ordered fold over them, classification and publishing.

Artefacts: artefact_id, url, origin, js_id, sha256 and the maps statements_by_count, calls_by_count,
literals_by_count.  Controls: origin, sha256, do_not_load, size_bytes, family, subfamily and the maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..functions.text import functions_list, join_literals, truncate_literals
from ..functions.url import url_fields

AST_SHARE = 0.55
CALL_SHARE = 0.8
LEAST_SUM = 50
NEAR_ZERO = 1e-5

_INF = float("inf")


def range_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, half_width: float) -> DataFrame:
    """Rows of left and right with right_value in [left_value - half_width, left_value + half_width).

    The right side falls into buckets as wide as the range, the left side into the at most three that its
    range meets: an equi-join on the bucket instead of a nested loop, then the exact test.
    """
    width = max(2 * half_width, 1e-9)
    bucket = lambda c: F.floor(c / width).cast("long")
    low, high = bucket(F.col(left_value) - half_width), bucket(F.col(left_value) + half_width)
    a = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    b = right.withColumn("_bucket", bucket(F.col(right_value)))
    inside = (F.col(right_value) >= F.col(left_value) - half_width) & (F.col(right_value) < F.col(left_value) + half_width)
    return a.join(b, "_bucket").where(inside).drop("_bucket")


def with_sums(rows: DataFrame) -> DataFrame:
    """sum_ast (over the known statement kinds), sum_calls and sum_literals added."""
    return rows.withColumns({
        "sum_ast": V.total(V.ast_vector(F.col("statements_by_count"))),
        "sum_calls": V.map_total(F.col("calls_by_count")),
        "sum_literals": V.map_total(F.col("literals_by_count")),
    })


def load_controls(controls: DataFrame, code: DataFrame | None = None, min_size: int = 1500, load_all: bool = False) -> DataFrame:
    """Controls that take part: large enough, not excluded, and with stored code if code is given."""
    rows = controls if load_all else controls.where((F.col("size_bytes") >= min_size) & ~F.coalesce("do_not_load", F.lit(False)))
    return rows.join(code.select("origin"), "origin", "left_semi") if code is not None else rows


def plausible_controls(artefacts: DataFrame, summary: DataFrame, max_distance: float = 200.0, strategies: Sequence[str] = ("ast", "calls")) -> DataFrame:
    """artefact_id, origin and the first strategy (0 ast, 1 calls) that finds the control.

    artefacts: artefact_id, sum_ast, sum_calls.  summary: origin, sum_ast, sum_calls; controls under
    LEAST_SUM by the strategy's sum are too small to tell anything.  The window is part of the result:
    a control outside it is never compared.
    """
    found = None
    for number, (name, share) in enumerate((("ast", AST_SHARE), ("calls", CALL_SHARE))):
        if name not in strategies:
            continue
        a = artefacts.select("artefact_id", F.col(f"sum_{name}").cast("double").alias("wanted"))
        b = summary.where(F.col(f"sum_{name}") >= LEAST_SUM).select("origin", F.col(f"sum_{name}").cast("double").alias("offered"))
        part = range_join(a, b, "wanted", "offered", share * max_distance).select("artefact_id", "origin", F.lit(number).alias("strategy"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("artefact_id", "origin").agg(F.min("strategy").alias("strategy"))


def scored_candidates(artefacts: DataFrame, controls: DataFrame, plausible: DataFrame, max_distance: float = _INF) -> DataFrame:
    """plausible with the distances of each pair; controls that are excluded drop out, and pairs beyond max_distance.

    The total is at least half the statement distance, so pairs that it puts out of reach skip the maps.
    """
    usable = controls.where(~F.coalesce("do_not_load", F.lit(False)))
    a = artefacts.select("artefact_id", F.col("sha256").alias("own_sha"), V.ast_vector(F.col("statements_by_count")).alias("own_ast"), V.hashed(F.col("calls_by_count")).alias("own_calls"))
    b = usable.select("origin", F.col("sha256").alias("control_sha"), V.ast_vector(F.col("statements_by_count")).alias("control_ast"), V.hashed(F.col("calls_by_count")).alias("control_calls"))
    # few bytes but much work for each pair: partitions by number, which adaptive execution does not merge
    tasks = int(plausible.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = plausible.repartition(tasks, "artefact_id").join(b, "origin").join(a, "artefact_id")
    pairs = pairs.withColumns({
        "ast_dist": V.vector_distance(F.col("own_ast"), F.col("control_ast")),
        "same_sha": F.coalesce(F.col("own_sha") == F.col("control_sha"), F.lit(False)),
    }).where(F.col("ast_dist") * 0.5 <= max_distance)
    pairs = pairs.withColumn("function_dist", V.function_distances(F.col("own_calls"), F.col("control_calls")))
    pairs = pairs.withColumn("total", V.total_distance(F.col("ast_dist"), F.col("function_dist")))
    return pairs.select("artefact_id", "strategy", "origin", "total", "ast_dist", "function_dist", "same_sha")


def fold_best(candidates: Column, max_distance: float) -> Column:
    """struct(best, second) of an array of candidates in the order in which they are tried.

    A candidate nearer than the best so far replaces it, unless the composite distance says
    otherwise; then it may become the second.  The search ends at a distance near zero, the only
    place where hashes are compared.  Without a candidate the best is an empty hit at infinity.
    """
    kind = "struct<control_url:string,total:double,composite:double,ast_dist:double,function_dist:double,sha256_matched:boolean>"
    empty = F.struct(
        F.lit("").alias("control_url"), F.lit(_INF).alias("total"), F.lit(_INF).alias("composite"), F.lit(_INF).alias("ast_dist"),
        F.lit(_INF).alias("function_dist"), F.lit(False).alias("sha256_matched"),
    ).cast(kind)
    start = F.struct(empty.alias("best"), F.lit(None).cast(kind).alias("second"), F.lit(False).alias("done"))

    def step(state: Column, c: Column) -> Column:
        best, second = state["best"], state["second"]
        composite = V.composite_distance(c["ast_dist"], c["function_dist"], F.lit(0.0))
        final = c["total"] < NEAR_ZERO
        hit = lambda matched: F.struct(
            c["origin"].alias("control_url"), c["total"].alias("total"), composite.alias("composite"), c["ast_dist"].alias("ast_dist"),
            c["function_dist"].alias("function_dist"), matched.alias("sha256_matched"),
        ).cast(kind)
        state_of = lambda b, s, d: F.struct(b.alias("best"), s.alias("second"), d.alias("done"))
        # NaN is the largest of all to Spark, so it never counts as nearer
        nearer = (c["total"] < best["total"]) & (c["total"] <= max_distance)
        lasting = best["composite"] < composite
        better_second = second.isNull() | (second["composite"] > composite)
        return (
            F.when(state["done"] | ~nearer, state)
            .when(lasting & better_second, state_of(best, hit(F.lit(False)), F.lit(False)))
            .when(lasting, state)
            .otherwise(state_of(hit(final & c["same_sha"]), best, final))
        )

    return F.aggregate(candidates, start, step, lambda s: F.struct(s["best"].alias("best"), s["second"].alias("second")))


def best_controls(artefacts: DataFrame, controls: DataFrame, max_distance: float = 200.0, strategies: Sequence[str] = ("ast", "calls")) -> DataFrame:
    """artefact_id, best and second for every artefact; candidates are tried by (strategy, origin).

    The candidates of one artefact are bounded by the controls in its window, so they are gathered per
    artefact; the pairs themselves are spread over all tasks.
    """
    a, b = with_sums(artefacts), with_sums(controls)
    plausible = plausible_controls(a, b, max_distance, strategies)
    scored = scored_candidates(artefacts, controls, plausible, max_distance)
    # not a filter: that would move below the distances and compute them a second time
    candidate = F.when(F.col("total") <= max_distance, F.struct("strategy", "origin", "total", "ast_dist", "function_dist", "same_sha"))
    ordered = F.array_sort(F.collect_list(candidate))
    tried = scored.groupBy("artefact_id").agg(ordered.alias("candidates"))
    rows = artefacts.select("artefact_id").join(tried, "artefact_id", "left")
    candidates = F.coalesce("candidates", F.array().cast(tried.schema["candidates"].dataType))
    return rows.select("artefact_id", fold_best(candidates, max_distance).alias("f")).select("artefact_id", "f.best", "f.second")


def with_differences(hits: DataFrame, artefacts: DataFrame, controls: DataFrame) -> DataFrame:
    """Hits (artefact_id, control_url, ...) with the differing functions and the literal fields.

    Without a control the numbers are -1 and the texts empty.  Only hits that were chosen get here, so
    the maps are compared for few pairs.
    """
    own = artefacts.select("artefact_id", F.col("calls_by_count").alias("_calls"), truncate_literals(F.col("literals_by_count")).alias("_own"))
    other = controls.select(F.col("origin").alias("control_url"), F.col("calls_by_count").alias("_control_calls"), truncate_literals(F.col("literals_by_count")).alias("_control"))
    both = hits.join(own, "artefact_id").join(other, "control_url", "left").withColumn("_l", V.literal_distance(F.col("_control"), F.col("_own")))
    known = F.col("_control").isNotNull()
    value = lambda c, none: F.when(known, c).otherwise(none)
    return both.withColumns({
        "diff_functions": value(F.array_join(V.differing_keys(F.col("_calls"), F.col("_control_calls")), " "), ""),
        "literal_dist": value(F.col("_l.dist"), -1.0),
        "literals_not_in_origin": value(F.col("_l.n_not_in_origin"), -1),
        "literals_not_in_control": value(F.col("_l.n_not_in_control"), -1),
        "n_diff_literals": value(F.size("_l.diff"), -1),
        "diff_literals": value(join_literals(F.col("_l.diff")), ""),
    }).drop("_own", "_control", "_calls", "_control_calls", "_l")


def hit_id(origin_url: Column, control_url: Column) -> Column:
    """A stable 24-digit id of a (script, control) pair."""
    return F.substring(F.sha2(F.concat_ws("\0", origin_url, control_url), 256), 1, 24)


def evaluate(artefacts: DataFrame, controls: DataFrame, max_distance: float = 300.0, strategies: Sequence[str] = ("ast", "calls")) -> DataFrame:
    """The hits that are emitted: every artefact's best, and the next best if it is as near and under 50."""
    found = best_controls(artefacts, controls, max_distance, strategies)
    ranked = found.select("artefact_id", F.posexplode(F.array("best", "second")).alias("rank", "hit")).where(F.col("hit").isNotNull())
    hits = with_differences(ranked.select("artefact_id", "rank", "hit.*").drop("total", "composite"), artefacts, controls)
    hits = hits.join(artefacts.select("artefact_id", F.col("url").alias("origin_url"), F.col("origin").alias("cited_on"), F.col("js_id").alias("origin_js_id")), "artefact_id")
    judged = V.composite_distance(F.col("ast_dist"), F.col("function_dist"), F.greatest("literal_dist", F.lit(0.0)))
    hits = hits.withColumns({"xref": hit_id(F.col("origin_url"), F.col("control_url")), "composite": judged})
    # an artefact has two rows at most
    best = F.max(F.when(F.col("rank") == 0, F.col("composite"))).over(Window.partitionBy("artefact_id"))
    hits = hits.withColumn("_best", best)
    emitted = (F.col("rank") == 0) | ((F.col("control_url") != "") & (F.col("composite") <= F.col("_best")) & (F.col("composite") < 50))
    return hits.where(emitted).drop("_best")


def classify(hits: DataFrame, max_distance: float = 300.0) -> DataFrame:
    """Hits with ok and reason."""
    return hits.withColumn("_g", V.good_hit(F.col("ast_dist"), F.col("function_dist"), F.col("literal_dist"), F.col("diff_functions"), max_distance)).select("*", "_g.ok", "_g.reason").drop("_g")


def with_url_fields(hits: DataFrame) -> DataFrame:
    return hits.select("*", *url_fields(F.col("origin_url"), "origin"), *url_fields(F.col("cited_on"), "cited_on"))


def publish(hits: DataFrame, controls: DataFrame, max_distance: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """(good, bad) hits with url fields, family and function arrays.

    Good hits have an xref, pass the classifier, name a control that is still known, and have hosts for
    script and page.  Bad hits are those with an xref that fail it.
    """
    rows = classify(hits.where(F.col("xref").isNotNull()), max_distance).withColumn("diff_functions", functions_list(F.col("diff_functions")))
    known = controls.select(F.col("origin").alias("control_url"), F.col("family").alias("control_family")).dropDuplicates(["control_url"])
    # urls are taken apart for the hits that are left
    good = with_url_fields(rows.where("ok").join(known, "control_url")).where(F.col("origin_host").isNotNull() & F.col("cited_on_host").isNotNull())
    return good, with_url_fields(rows.where(~F.col("ok")))


def poor_hits(hits: DataFrame, latest: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Hits that are far by statements, with url fields and the hash of their script (latest: url, sha256)."""
    scripts = latest.select(F.col("url").alias("origin_url"), "sha256")
    return with_url_fields(hits.where(F.col("ast_dist") > threshold)).join(scripts, "origin_url", "left")


def nearest(vectors: DataFrame, controls: DataFrame, id_col: str, control_col: str, vector_col: str, block: int = 1000) -> DataFrame:
    """For each dense vector the nearest control vector (ties: smallest id) and its distance.

    Up to `block` controls become a constant of the plan: no join.  More are dealt into blocks of about that size, each
    one row; every distinct vector meets each block once, so rows grow with vectors times blocks, not with pairs.
    Without controls id and distance are null.
    """
    own = F.col(vector_col).cast("array<double>")
    listed = controls.select(F.struct(F.col(control_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).alias("c"))
    best = lambda v, cs: F.array_min(F.transform(cs, lambda c: F.struct(V.euclidean(v, c["v"]).alias("dist"), c["id"].alias("id"))))
    rows = listed.select(F.to_json("c").alias("c")).limit(block + 1).collect()
    if len(rows) <= block:
        constant = F.from_json(F.lit("[" + ",".join(r["c"] for r in rows) + "]"), T.ArrayType(listed.schema["c"].dataType))
        found = vectors.select(id_col, best(own, constant).alias("b"))
    else:
        n = -(-listed.count() // block)
        blocks = listed.groupBy(F.pmod(F.xxhash64("c.id"), F.lit(n)).alias("_block")).agg(F.collect_list("c").alias("cs"))
        each = vectors.select(own.alias("_v")).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        least = each.join(blocks, "_block").groupBy("_v").agg(F.min(best(F.col("_v"), F.col("cs"))).alias("b"))
        found = vectors.select(id_col, own.alias("_v")).join(least, "_v", "left").select(id_col, "b")
    return found.select(id_col, F.col("b.id").alias("control_id"), F.col("b.dist").alias("dist"))
