"""Distances between sparse and dense count vectors, as expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The statement kinds of a syntax tree, in the order of the dense vector, and their weights.
AST_FEATURES = (
    "ArrayLiteral", "Assignment", "AstRoot", "Block", "BreakStatement", "CatchClause", "ConditionalExpression", "ContinueStatement", "DoLoop",
    "ElementGet", "EmptyExpression", "EmptyStatement", "ExpressionStatement", "ForInLoop", "ForLoop", "FunctionCall", "FunctionNode", "IfStatement",
    "InfixExpression", "KeywordLiteral", "Label", "LabeledStatement", "Name", "NewExpression", "NumberLiteral", "ObjectLiteral", "ObjectProperty",
    "ParenthesizedExpression", "PropertyGet", "RegExpLiteral", "ReturnStatement", "Scope", "StringLiteral", "SwitchCase", "SwitchStatement",
    "ThrowStatement", "TryStatement", "UnaryExpression", "VariableDeclaration", "VariableInitializer", "WhileLoop", "WithStatement", "XmlLiteral", "XmlString",
)
#: Weights other than 1.
AST_WEIGHTS = {
    "ArrayLiteral": 0.5, "AstRoot": 0.1, "BreakStatement": 1.1, "CatchClause": 1.1, "ElementGet": 0.8, "EmptyExpression": 0.1,
    "EmptyStatement": 0.1, "FunctionCall": 0.8, "RegExpLiteral": 0.8, "StringLiteral": 0.6, "XmlLiteral": 0.7, "XmlString": 0.7,
}

#: Vectors of fewer entries are penalised by SHORT_SCALE / entries.
SHORT = 15
SHORT_SCALE = 20.0


def _listed(values: Sequence[object]) -> Column:
    """A constant array of texts; one short expression however many there are, so that plans stay small."""
    return F.split(F.lit("\n".join(map(str, values))), "\n")


def dense(counts: Column, names: Sequence[str], weights: dict[str, float] | None = None) -> Column:
    """The counts of names as an array, 0 where missing; whole numbers unless weighted."""
    found = F.transform(_listed(names), lambda n: F.coalesce(F.element_at(counts, n), F.lit(0)))
    if weights is None:
        return found
    return F.zip_with(found, _listed([float(weights.get(x, 1.0)) for x in names]).cast("array<double>"), lambda x, w: x * w)


def ast_vector(counts: Column, weighted: bool = False) -> Column:
    return dense(counts, AST_FEATURES, AST_WEIGHTS if weighted else None)


def total(values: Column) -> Column:
    """The sum of an array of numbers."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def map_total(counts: Column) -> Column:
    """The sum of a map's counts, 0 for an empty map."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda s, x: s + x)


def _short_penalty(n: Column) -> Column:
    return F.when(n < SHORT, SHORT_SCALE / F.greatest(n, F.lit(1))).otherwise(1.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def vector_distance(a: Column, b: Column, short_penalty: bool = True) -> Column:
    """Euclidean distance, larger for short vectors if short_penalty."""
    d = euclidean(a, b)
    return d * _short_penalty(F.size(a)) if short_penalty else d


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def _paired(a: Column, b: Column) -> Column:
    """For all keys of two maps, their counts (x, y), 0 where missing."""
    return F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, F.lit(0)).alias("x"), F.coalesce(y, F.lit(0)).alias("y")))


def differing_keys(a: Column, b: Column) -> Column:
    """The keys with unequal counts, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(_paired(a, b), lambda k, v: v["x"] != v["y"])))


def _statistics(pairs: Column, finish) -> Column:
    """finish(struct(n, common, ss)) over pairs of counts: how many, how many equal, and the sum of squared differences."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("common"), F.lit(0.0).alias("ss"))

    def step(s: Column, v: Column) -> Column:
        gap = v["x"] - v["y"]
        return F.struct((s["n"] + 1).alias("n"), (s["common"] + (gap == 0).cast("int")).alias("common"), (s["ss"] + gap * gap).alias("ss"))

    return F.aggregate(pairs, start, step, finish)


def function_distance(origin: Column, control: Column) -> Column:
    """Distance of call counts: infinite without any key; scaled by unequal over equal keys, or by 10 if none is equal."""

    def finish(s: Column) -> Column:
        factor = F.when(s["common"] > 0, (s["n"] - s["common"]) / s["common"]).otherwise(10.0)
        return F.when(s["n"] == 0, F.lit(float("inf"))).otherwise(F.sqrt(s["ss"]) * factor * _short_penalty(s["n"]))

    return _statistics(F.map_values(_paired(origin, control)), finish)


def hashed(counts: Column) -> Column:
    """A count map as struct(keys, values): 64-bit hashes of its keys, and its counts."""
    return F.struct(F.transform(F.map_keys(counts), lambda k: F.xxhash64(k)).alias("keys"), F.map_values(counts).alias("values"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, keys and values of an array of hashed maps."""
    keys, values = column.field("keys"), column.field("values")
    sizes = np.diff(keys.offsets.to_numpy())
    flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), flat(keys), flat(values).astype(np.float64)


def _grouped(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order that puts equal (row, key) next to each other: by one mixed number, which sorts much faster than two.

    Should the numbers of different pairs be equal, by both.
    """
    mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(mixed)
    a, b = order[1:], order[:-1]
    if ((mixed[a] == mixed[b]) & ((row[a] != row[b]) | (key[a] != key[b]))).any():
        return np.lexsort((key, row))
    return order


def function_distances(origin: Column, control: Column) -> Column:
    """function_distance of hashed maps: all pairs of a batch are compared at once."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (row_a, key_a, x), (row_b, key_b, y) = _flat(a), _flat(b)
        row, key, value = np.concatenate([row_a, row_b]), np.concatenate([key_a, key_b]), np.concatenate([x, -y])
        order = _grouped(row, key)
        row, key, value = row[order], key[order], value[order]
        # a key of both maps is twice in a row
        again = np.zeros(len(row), bool)
        again[1:] = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
        first = ~again
        gap = value[first].copy()
        gap[np.cumsum(first)[again] - 1] += value[again]
        count = lambda at, weights=None: np.bincount(at, weights, len(a))
        n, same, ss = count(row[first]), count(row[first][gap == 0]), count(row[first], gap * gap)
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = np.where(same > 0, (n - same) / same, 10.0)
            short = np.where(n < SHORT, SHORT_SCALE / np.maximum(n, 1), 1.0)
        return pa.array(np.where(n == 0, np.inf, np.sqrt(ss) * factor * short))

    return run(origin, control)


def literal_distance(control: Column, origin: Column) -> Column:
    """struct(dist, n_not_in_origin, n_not_in_control, diff): distance of literal counts, keys on one side only, differing keys."""
    return F.struct(
        _statistics(F.map_values(_paired(origin, control)), lambda s: F.sqrt(s["ss"]) * _short_penalty(s["n"])).alias("dist"),
        F.size(F.array_except(F.map_keys(control), F.map_keys(origin))).alias("n_not_in_origin"),
        F.size(F.array_except(F.map_keys(origin), F.map_keys(control))).alias("n_not_in_control"),
        differing_keys(origin, control).alias("diff"),
    )


def total_distance(ast: Column, calls: Column) -> Column:
    """The distance by which controls are ranked."""
    return ast * 0.75 * calls + (ast + calls) * 0.5


def composite_distance(ast: Column, calls: Column, literal: Column, ast_weight: float = 0.8, call_weight: float = 1.5) -> Column:
    """The distance by which hits are judged."""
    a, f = ast * ast_weight, calls * call_weight
    return (a + f) * (f + literal) + a + f + literal


def good_hit(ast: Column, calls: Column, literal: Column, diff_functions: Column, max_distance: float = 200.0) -> Column:
    """struct(ok, reason): whether a hit is good, by the first rule that applies.

    diff_functions is blank-separated; a hit whose literal distance is unknown (negative) is not good.
    """
    n_diff = F.length(diff_functions) - F.length(F.replace(diff_functions, F.lit(" "), F.lit("")))
    near = ((ast < 10) | ((ast < 20) & (n_diff < 10))) & (ast > 0) & (calls > 0)
    ordered = F.array_sort(F.array(ast, calls, literal))
    two = F.element_at(ordered, 1) * F.element_at(ordered, 2)
    # infinity times zero is no number, and no number is small
    small = ~F.isnan(two) & (two < 25)
    result = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), F.lit(reason).alias("reason"))
    return (
        F.when(near, result(True, "original_criteria"))
        .when(literal < 0, result(False, "bad_literal_dist"))
        .when(~F.isnan(composite_distance(ast, calls, literal)) & (composite_distance(ast, calls, literal) <= max_distance), result(True, f"dist_lt_{float(max_distance)}"))
        .when(small, result(True, "good_two_smallest_distances"))
        .otherwise(result(False, "failed_every_test"))
    )
