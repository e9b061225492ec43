"""Outliers among hits: a matrix of seven numbers for each hit, robust distances, and principal components."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised, ship

FEATURES = ["ast_dist", "function_dist", "literal_dist", "literals_not_in_origin", "literals_not_in_control", "n_diff_literals", "rarest_probability"]
LEAST_ROWS = 15
#: So many values of a partition bracket an order statistic in one pass; fewer are sent as they are.
MARKS = 256


def selected(hits: DataFrame, controls: DataFrame, control: str | None = None, family: str | None = None, subfamily: str | None = None) -> DataFrame:
    """The hits of one control, or of controls whose family and subfamily hold these patterns (case counts)."""
    if control is not None:
        controls = controls.where(F.col("origin") == control)
    for name, pattern in (("family", family), ("subfamily", subfamily)):
        if pattern:
            controls = controls.where(F.col(name).rlike(pattern))
    return hits.join(controls.select(F.col("origin").alias("control_url")), "control_url", "left_semi")


def matrix(hits: DataFrame, probabilities: DataFrame, since: str | None = None, created: str = "created_at") -> DataFrame:
    """Per xref with functions and without hash match: its numbers and the rarest function's probability.

    An xref stands for a script and its control, so rows are grouped by both: where the probabilities are too
    large to broadcast, the join by control deals the rows and the groups need no second shuffle.
    """
    rows = hits.where(~F.col("sha256_matched") & (F.size("diff_functions") > 0))
    if since is not None:
        rows = rows.where(F.col(created) >= F.lit(since).cast("timestamp"))
    known = probabilities.groupBy("control_url").agg(F.collect_list(F.struct("function_name", "sites_probability")).alias("_known"))
    least = lambda f: F.array_min(F.transform(F.filter("_known", lambda k: k["function_name"] == f), lambda k: k["sites_probability"]))
    rare = F.array_min(F.transform("diff_functions", lambda f: F.struct(F.coalesce(least(f), F.lit(1.0)).alias("p"), f.alias("function_name"))))
    rows = rows.select("xref", "control_url", "origin_url", "cited_on", *FEATURES[:-1], "diff_functions").join(known, "control_url", "left").withColumn("_rare", rare)
    first = F.min(F.struct("origin_url", "cited_on", *FEATURES[:-1]))
    found = rows.groupBy("control_url", "xref").agg(first.alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("diff_functions")))).alias("diff_functions"), F.min("_rare").alias("r"))
    return found.select("xref", "control_url", "x.*", "diff_functions", F.col("r.function_name").alias("rarest_function"), F.col("r.p").alias("rarest_probability"))


def _parts(table: DataFrame, of: Callable[[np.ndarray, np.ndarray], object]) -> list:
    """What `of` makes of each partition's hashes and rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if kept:
            hashes = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in kept])
            held = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]) for b in kept]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(of(hashes, np.concatenate(held)))], pa.binary())], names=["made"])

    return [pickle.loads(r.made) for r in table.mapInArrow(run, "made binary").collect()]


def _distances(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    gap = x - mean
    return np.einsum("ij,jk,ik->i", gap, inverse, gap)


def _nearest(table: DataFrame, states: list[tuple], ranks: list[int]) -> list[tuple]:
    """For each state (determinant, mean, inverse) and rank: the distance of that rank, counted from one, and the
    number, sum and products of the gaps of all rows up to it.

    Each pass narrows the bracket (low, high] of the distance by marks from every partition, until
    the partitions can send what lies in it.
    """
    bounds, done = [(-np.inf, np.inf)] * len(states), [None] * len(states)
    while open_ := [n for n, x in enumerate(done) if x is None]:

        def of(_: np.ndarray, x: np.ndarray, asked=[(n, *states[n][1:], *bounds[n]) for n in open_]) -> dict:
            out = {}
            for n, mean, inverse, low, high in asked:
                d, gap = _distances(x, mean, inverse), x - mean
                inner, between = gap[d <= low], (d > low) & (d <= high)
                values, counts = np.unique(d[between], return_counts=True)
                whole = len(values) <= MARKS
                at = np.arange(len(values)) if whole else np.unique(np.linspace(0, len(values) - 1, MARKS).astype(int))
                kept = []
                if whole:  # rows of one distance together, so that equal ones are one entry
                    place = np.searchsorted(values, d[between])
                    sums, products = np.zeros((len(values), x.shape[1])), np.zeros((len(values), x.shape[1], x.shape[1]))
                    np.add.at(sums, place, g := gap[between])
                    np.add.at(products, place, g[:, :, None] * g[:, None])
                    kept = [sums, products]
                out[n] = (len(inner), inner.sum(axis=0), inner.T @ inner, whole, values[at], np.cumsum(counts)[at], (np.cumsum(counts) - counts)[at], int(counts.sum()), kept)
            return out

        parts = _parts(table, of)
        for n in open_:
            own, rank = [p[n] for p in parts], ranks[n] - sum(p[n][0] for p in parts)
            marks = np.unique(np.concatenate([p[4] for p in own]))
            least, most = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64)
            for _, _, _, _, values, upto, before, total, _ in own:
                at = np.searchsorted(values, marks, side="right")
                least += np.concatenate([[0], upto])[at]
                most += np.concatenate([before, [total]])[at]
            # of equal marks in a partition `most` counts up to the next mark
            high = marks[int(np.argmax(least >= rank))]
            if all(p[3] for p in own):
                count, sums, products = sum(p[0] for p in own), sum(p[1] for p in own), sum(p[2] for p in own)
                for p in own:
                    inside = p[4] <= high
                    count += int(p[5][inside][-1]) if inside.any() else 0
                    sums, products = sums + p[8][0][inside].sum(axis=0), products + p[8][1][inside].sum(axis=0)
                done[n] = (float(high), count, sums, products)
            else:
                below = marks[most < rank]
                bounds[n] = (float(below[-1]) if len(below) else bounds[n][0], float(high))
    return done


def robust_location(table: DataFrame, n: int, seed: int = 3, starts: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Mean and inverse covariance of the half of the rows whose covariance has the least determinant.

    table has a hash and the numbers of each of n rows.  All starts take their steps together, and
    every step counts all rows; rows as far as the last of the half belong to it.
    """
    d = len(FEATURES)
    h = (n + d + 1) // 2

    def step(count: int, centre: np.ndarray, sums: np.ndarray, products: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = sums / count
        cov = (products - count * np.outer(mean, mean)) / (count - 1) + 1e-9 * np.eye(d)
        return np.linalg.slogdet(cov)[1], centre + mean, np.linalg.pinv(cov)

    def first(hashes: np.ndarray, x: np.ndarray) -> list[tuple]:
        out = []
        for k in range(starts):
            keys = hashes.view(np.uint64) ^ np.uint64((seed + k) * 0x9E3779B97F4A7C15 % 2**64)
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            at = np.argsort(keys, kind="stable")[: d + 1]
            out.append((keys[at], x[at]))
        return out

    parts, states = _parts(table, first), []
    for k in range(starts):
        keys, x = (np.concatenate([p[k][i] for p in parts]) for i in (0, 1))
        x = x[np.argsort(keys, kind="stable")[: d + 1]]
        gap = x - x.mean(axis=0)
        states.append(step(len(x), x.mean(axis=0), gap.sum(axis=0), gap.T @ gap))
    moving = list(range(starts))
    while moving:
        found = _nearest(table, [states[k] for k in moving], [h] * len(moving))
        new = {k: step(count, states[k][1], sums, products) for k, (_, count, sums, products) in zip(moving, found)}
        moving = [k for k in moving if new[k][0] < states[k][0] - 1e-9]
        for k in moving:
            states[k] = new[k]
    return min(states, key=lambda x: x[0])[1:]


def outliers(rows: DataFrame, contamination: float = 0.1) -> DataFrame:
    """rows with distance and is_outlier: the rows beyond the quantile of robust distances; none of few rows.

    The location and the quantile are those of all distinct rows; every row is scored.  Rows are written once,
    as they are read twice: leave out columns that nothing needs.
    """
    ship(rows.sparkSession)
    rows = materialised(rows, "outlier-rows")
    clean = [F.coalesce(F.col(c).cast("double"), F.lit(1.0 if c == "rarest_probability" else 0.0)).alias(c) for c in FEATURES]
    distinct = rows.select(clean).distinct().select(F.xxhash64(*FEATURES).alias("hash"), *FEATURES).sortWithinPartitions(*FEATURES)
    table = materialised(distinct, "outliers")
    n = table.count()
    if n <= LEAST_ROWS:
        return rows.withColumns({"distance": F.lit(None).cast("double"), "is_outlier": F.lit(False)})
    mean, inverse = robust_location(table, n)
    place = (n - 1) * (1 - contamination)
    ranks = [int(place) + 1, min(int(place) + 2, n)]
    low, high = (x[0] for x in _nearest(table, [(0.0, mean, inverse)] * 2, ranks))
    limit = low + (high - low) * (place - int(place))

    @F.pandas_udf("double")
    def distance(x: pd.DataFrame) -> pd.Series:
        gap = x.to_numpy(float) - mean
        return pd.Series(np.einsum("ij,jk,ik->i", gap, inverse, gap))

    return rows.withColumn("distance", distance(F.struct(*clean))).withColumn("is_outlier", F.col("distance") > limit)


def principal_components(rows: DataFrame, k: int = 2, dropped: int = 5) -> DataFrame:
    """rows with pc1, pc2, ...: scores on the first k components of the features, without the one at place `dropped`.

    Of a component's two directions the one whose largest coefficient is positive is taken.  Rows are written once,
    as the fit reads them twice before they are scored: leave out columns that nothing needs.
    """
    from pyspark.ml.feature import PCA, VectorAssembler

    rows = materialised(rows, "component-rows")
    names = [c for n, c in enumerate(FEATURES) if n != dropped]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
    ready = VectorAssembler(inputCols=names, outputCol="_v").transform(rows.select(*(v.alias(c) for v, c in zip(values, names))))
    components = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready).pc.toArray().T
    components = [c * np.sign(c[np.abs(c).argmax()]) for c in components]
    return rows.withColumns({f"pc{n + 1}": sum((v * float(w) for v, w in zip(values, c)), F.lit(0.0)) for n, c in enumerate(components)})
