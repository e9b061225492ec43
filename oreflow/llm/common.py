"""What the operators share: intermediate tables, shipped code, batch slicing and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import clear, drop, materialised, new_path, ship  # noqa: F401  the operators take them from here

#: Rows that a Python operator holds as Python objects at one time.
SLICE_ROWS = 256
#: Bytes of texts and binaries that it holds at one time, unless one row has more.
SLICE_BYTES = 4 << 20
#: Words of 64 bits that a filter of values has at most.
FILTER_WORDS = 1 << 19

#: A table written once to the shared folder and read from there.
cut = materialised


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a bounded number of rows, and of bytes of texts unless a single row has more."""
    for batch in batches:
        ends = None
        if batch.nbytes > size:
            wide = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)]
            ends = sum((np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for c in wide), np.zeros(batch.num_rows, np.int64))
        at = 0
        while at < batch.num_rows:
            stop = min(at + rows, batch.num_rows)
            if ends is not None:
                fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
                stop = min(stop, max(fits, at + 1))
            yield batch.slice(at, stop - at)
            at = stop


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def marked(rows: DataFrame, by: str, values: DataFrame, name: str) -> DataFrame:
    """rows and a column `name`: whether their number `by` may be one of values, a table of one column.

    True for all that are, and for few others: a bit of a filter stands for many numbers, 1 in 17 of those not
    in values being let through at two million values, and more at more.  The filter, FILTER_WORDS rows at
    most, goes to every executor, so rows are not shuffled; what must be exact is left to a join of the marked ones.
    """
    word, mask = f"{name}_word", f"{name}_mask"
    of = lambda column: F.xxhash64(F.col(column).cast("long"), F.lit(11))
    bit = lambda column: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(of(column), 58).cast("int"))
    place = lambda column: of(column).bitwiseAND(F.lit(FILTER_WORDS - 1))
    (value,) = values.columns
    masks = values.select(place(value).alias(word), bit(value).alias(mask)).groupBy(word).agg(F.bit_or(mask).alias(mask))
    found = rows.withColumn(word, place(by)).join(F.broadcast(masks), word, "left")
    return found.withColumn(name, F.coalesce(F.col(mask).bitwiseAND(bit(by)) != 0, F.lit(False))).select(*rows.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b).

    Returns node, root: every node with an edge to another node, and the smallest node it reaches.
    Large-star and small-star steps alternate; each is a minimum for each node and a join, so no
    node's neighbours are gathered in one place.  Rounds grow with the logarithm of a component's
    length.  Null ends and loops are ignored; no edges give no rows.
    """
    step = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    step, seen = cut(step, "edges"), None
    while True:
        state = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return step.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen, old = state, step
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(old)


def forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each node's smallest known companion) after also joining a and b, node by node."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        x, y = x[differ], y[differ]
        a, b = a[differ], b[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]
