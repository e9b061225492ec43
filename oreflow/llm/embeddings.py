"""Embedding near-duplicates: an exact metric range join by cosine.

Vectors are compared by angle, a metric.  Pivots partition them: each vector's home is the cell of
its nearest pivot.  If x links to some y at home in another cell j, the triangle inequality gives
angle(x, p_j) <= angle(x, p_home) + 2 eps and <= radius_j + eps, and x lies within eps of the plane
between the two pivots; x is copied to the cells that pass all three tests.  Each cell then finds
every link of its own members independently.  Large cells are cut into blocks of members, so a
task's rows are bounded, and no pair of rows ever leaves a task: a block gives each member's number of
links and a spanning forest of the links it saw.  Exact copies of a vector are one point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, forest, ship, slices

COSINE = 0.95
#: Points of a cell that are aimed at, and at most of a block: at least, and at most for very many points.
BLOCK = 8192
MAX_BLOCK = 32768
#: Pivots at most, besides twice the root of the number of points; a table of their angles is held for each slice.
MAX_PIVOTS = 4096
#: At most about so many points are looked at to choose pivots and how many.
PIVOT_SAMPLE = 4000
#: What a pair of vectors that is compared, a row that is dealt, and a point's angle to a pivot take, in seconds.
PAIR_COST, ROW_COST, ANGLE_COST = 1e-8, 2e-5, 1e-8
#: Rows of a block that are compared at one time.
TILE = 256
#: Room for rounding in the tests that only prune.
SLACK = 1e-6


def _points(wide: bool):
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            keys, vectors = [], []
            for v, known in zip(part.column(1).to_pylist(), part.column(0).is_valid().to_pylist()):
                data = None
                if known and v and None not in v:
                    x = np.array(v, kind) + 0  # -0 becomes 0
                    if np.isfinite(x).all() and x.any():
                        data = x.tobytes()
                vectors.append(data)
                keys.append(data and hashlib.blake2b(data, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "key", "vec"])

    return run


def _unit(rows: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of sample, each the farthest from those before it."""
    at = [0]
    nearest = sample @ sample[0]
    while len(at) < min(k, len(sample)):
        at.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[at[-1]])
    return sample[at]


@dataclass
class Cells:
    """The cells of vectors of one dimension; their numbers begin at first."""

    first: int
    pivots: np.ndarray
    eps: float
    radius: np.ndarray | None = None

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and its angles to all pivots."""
        cosines = np.clip(x @ self.pivots.T, -1, 1)
        return cosines.argmax(axis=1), np.arccos(cosines)

    def members(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and whether it belongs to or is copied to each cell."""
        home, angle = self.homes(x)
        own = angle[np.arange(len(x)), home]
        cosines = np.cos(angle)
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.clip(self.pivots @ self.pivots.T, -1, 1)))[home]
        chord = 2 * np.sin(self.eps / 2)
        inside = angle <= np.minimum(own[:, None] + 2 * self.eps, self.radius[None] + self.eps) + SLACK
        inside &= np.cos(own)[:, None] - cosines <= chord * gap + SLACK
        inside[np.arange(len(x)), home] = True
        return home, inside


def pivot_count(sample: np.ndarray, pivots: np.ndarray, eps: float, n: int, block: int) -> int:
    """How many of the pivots to use for n points: as many as make the join cheapest, judged by a sample without pivots.

    More pivots let the bounds exclude more, where vectors have clusters; where they have none, pivots only copy
    vectors to more cells.  The result of the join is the same for any number.
    """
    best, found, k = np.inf, 1, 1
    while k <= len(pivots) and len(sample):
        cell = Cells(0, pivots[:k], eps)
        home = cell.homes(sample)[0]
        cell.radius = np.full(k, np.pi)  # a few vectors of a cell do not tell its radius
        scale = n / len(sample)
        own, members = np.bincount(home, minlength=k) * scale, cell.members(sample)[1].sum(axis=0) * scale
        rows = own * np.ceil(members / block) + members * np.ceil(own / block)
        cost = PAIR_COST * (own * members).sum() + ROW_COST * rows.sum() + ANGLE_COST * n * k
        if cost < best:
            best, found = cost, k
        k *= 2
    return found


def _by_dimension(part: pa.RecordBatch, column: str, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(dimension, places of its rows) of a batch."""
    lengths = np.array([len(v) // size for v in part.column(column).to_pylist()])
    for d in np.unique(lengths):
        yield int(d), np.flatnonzero(lengths == d)


def _counted(cells: dict[int, Cells], kind: str):
    """Per task and cell: points at home, their radius, and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(c.pivots) for c in cells.values())
        home_n, radius, all_n = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        for part in slices(batches, 4096):
            vectors = part.column("vec").to_pylist()
            for d, at in _by_dimension(part, "vec", int(kind[-1])):
                cell, x = cells[d], _unit([vectors[i] for i in at], kind)
                home, angle = cell.homes(x)
                to = home + cell.first
                np.add.at(home_n, to, 1)
                np.maximum.at(radius, to, angle[np.arange(len(x)), home])
                if cell.radius is not None:
                    all_n[cell.first : cell.first + len(cell.pivots)] += cell.members(x)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(home_n), pa.array(radius), pa.array(all_n)], names=["cell", "home_n", "radius", "all_n"])

    return run


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): the places 0, 0, 1, 1, 1 and the numbers 0, 1, 0, 1, 2."""
    place = np.repeat(np.arange(len(counts)), counts)
    return place, np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)


def _dealt(cells: dict[int, Cells], kind: str, home_blocks: list[int], member_blocks: list[int]):
    """A row for each point and unit (cell, block of homes, block of members) that needs it."""
    homes_of, members_of = np.array(home_blocks, np.int64), np.array(member_blocks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            vectors = part.column("vec").to_pylist()
            places = np.array([int.from_bytes(k[:5], "little") for k in part.column("key").to_pylist()], np.int64)
            for d, at in _by_dimension(part, "vec", int(kind[-1])):
                cell = cells[d]
                home, inside = cell.members(_unit([vectors[i] for i in at], kind))
                n, j = np.nonzero(inside)
                c, own = j + cell.first, home[n] == j
                place = places[at[n]]
                # a point at home meets all blocks of members, and as a member all blocks of homes
                mine, b = _ranges(members_of[c[own]])
                theirs, a = _ranges(homes_of[c])
                first = c[own][mine] << 40 | place[own][mine] % homes_of[c[own][mine]] << 20 | b
                second = c[theirs] << 40 | a << 20 | (place[theirs] >> 20) % members_of[c[theirs]]
                unit, source = np.concatenate([first, second]), at[np.concatenate([n[own][mine], n[theirs]])]
                for k in range(0, len(unit), 8192):
                    rows = part.take(pa.array(source[k : k + 8192]))
                    cols = {x: rows.column(x) for x in ("key", "rep", "n", "vec")}
                    at_home = pa.array(np.arange(k, k + rows.num_rows) < len(first))
                    yield pa.RecordBatch.from_arrays([pa.array(unit[k : k + 8192]), at_home, *cols.values()], names=["unit", "home", *cols])

    return run


def _joined(kind: str, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        home = np.flatnonzero(table.column("home").to_numpy())
        member = np.flatnonzero(~table.column("home").to_numpy())
        vectors, keys = table.column("vec").to_pylist(), table.column("key").to_pylist()
        reps, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        out = {"key": [], "links": [], "node": [], "root": []}
        if len(home) and len(member):
            x, y = _unit([vectors[i] for i in home], kind), _unit([vectors[i] for i in member], kind)
            nodes, place = np.unique(reps, return_inverse=True)
            labels, counts = np.arange(len(nodes)), np.zeros(len(home), np.int64)
            for a in range(0, len(home), TILE):
                i, j = np.nonzero(x[a : a + TILE] @ y.T >= cosine)
                counts[a : a + TILE] = np.bincount(i, n[member[j]], min(TILE, len(home) - a)).astype(np.int64)
                labels = forest(labels, place[home[i + a]], place[member[j]])
            linked = np.flatnonzero(labels != np.arange(len(nodes)))
            out = {
                "key": [keys[i] for i in home] + [None] * len(linked),
                "links": counts.tolist() + [None] * len(linked),
                "node": [None] * len(home) + nodes[linked].tolist(),
                "root": [None] * len(home) + nodes[labels[linked]].tolist(),
            }
        return pa.table({"key": pa.array(out["key"], pa.binary()), **{k: pa.array(out[k], pa.int64()) for k in ("links", "node", "root")}})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int | None = None, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths.  A row without id links with nothing and has no component.
    A cosine of exactly the threshold links.  Repeated rows are copies of a vector and link with each other; rows
    that share an id are one vector to the components.  An empty table gives no rows; other columns are not
    read.  Vectors may have any length; ids must be numbers.
    """
    spark = vectors.sparkSession
    ship(spark)
    wide = not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f8" if wide else "<f4"
    size, eps = int(kind[-1]), float(np.arccos(cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("v"))
    rows = cut(rows.mapInArrow(_points(wide), "vec_id long, key binary, vec binary"), "vectors")
    points = cut(rows.where("key is not null").groupBy("key", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("key", "rep", "n", "vec"), "points")

    # pivots: a bounded sample by hash, for each dimension
    sizes = {r["d"]: r["n"] for r in points.groupBy((F.octet_length("vec") / size).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()}
    # larger blocks copy fewer rows; with many points there are still blocks enough for all tasks
    block = block or min(MAX_BLOCK, max(BLOCK, sum(sizes.values()) // 32))
    cells, first = {}, 0
    for d, n in sorted(sizes.items()):
        share = int(min(1, PIVOT_SAMPLE / n) * (1 << 30))
        same = points.where(F.octet_length("vec") == d * size).select("key", "vec")
        some = same.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) <= share).limit(2 * PIVOT_SAMPLE).collect() or same.limit(1).collect()
        sample = _unit([bytes(r["vec"]) for r in sorted(some, key=lambda r: bytes(r["key"]))], kind)
        pivots = choose_pivots(sample[::2], min(max_pivots, int(2 * n**0.5)))
        cells[d] = Cells(first, pivots[: pivot_count(sample[1::2], pivots, eps, n, block)], eps)
        first += len(cells[d].pivots)

    def count() -> dict[int, tuple]:
        found = points.mapInArrow(_counted(cells, kind), "cell int, home_n long, radius double, all_n long")
        found = found.groupBy("cell").agg(F.sum("home_n").alias("home_n"), F.max("radius").alias("radius"), F.sum("all_n").alias("all_n"))
        return {r["cell"]: (r["home_n"], r["radius"], r["all_n"]) for r in found.collect()}

    none = (0, 0.0, 0)
    if cells:
        found = count()
        for c in cells.values():
            c.radius = np.array([found.get(c.first + j, none)[1] for j in range(len(c.pivots))])
        found = count()
    else:
        found = {}
    blocks = [[max(1, -(-found.get(c, none)[k] // block)) for c in range(first)] for k in (0, 2)]
    dealt = points.mapInArrow(_dealt(cells, kind, *blocks), "unit long, home boolean, key binary, rep long, n long, vec binary")
    joined = cut(dealt.groupBy("unit").applyInArrow(_joined(kind, cosine), "key binary, links long, node long, root long"), "links")

    # every point meets itself once, and is no link of its own
    counts = joined.where("key is not null").groupBy("key").agg((F.sum("links") - 1).alias("n_links"))
    roots = components(joined.where("node is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = points.select("key", "rep").join(counts, "key").join(roots, F.col("rep") == F.col("node"), "left")
    found = cut(found.select("key", "n_links", F.coalesce("root", "rep").alias("component_id")), "linked")
    out = rows.select("vec_id", "key").join(found, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
