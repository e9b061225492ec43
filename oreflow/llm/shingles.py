"""Near-duplicates by the Jaccard similarity of sets of word shingles: operator 7 for similarities.

At a similarity of 0.8 SimHash bits differ with a probability of 0.151 (the angle between the sets), ten of 64
on average, so such texts need not share a byte of 64 bits.  The fingerprint here is the SimHash of the set over
POSITIONS positional bytes, each shared with a probability of 0.269.  The rest is operator 7's method:

* The inverted index has a posting list for each of the FIRST positions and its byte.  In it, texts meet that share
  one of EACH further positions as well.  Texts of similarity 0.8 meet nowhere with probability 1e-7.
* Texts that meet and differ in at most CHECK_BITS of the first CHECK bytes (more with probability 4e-8) are
  candidates; a forest of them leaves a task, so rows grow with the texts.  Their components are compared.
* Within a component texts are tallied over all positional bytes, and retained from LEAST shared ones on.  At 0.8 they
  share 51 on average; fewer than LEAST have a probability of 5e-9.
* Retained pairs are verified by their whole sets, so no link is an estimate.

Sets of four and five shingles are the one exception: their bits are even more often equal numbers of
ones and zeros, differ with probability 0.1875, and about 1e-4 of such pairs are not met.

Texts of equal sets are one class.  A long list or component is cut into blocks of bounded size, which are compared
two by two, each two in one place; what leaves a task is not pairs but a spanning forest of the links that it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, forest, marked, ship, slices
from .simhash import SEED, shingle_hashes, signs

WORDS = 5
#: The least similarity of linked texts, in fifths.
FIFTHS = 4
#: Posting lists are of the bytes of so many positions; in a list texts meet by EACH others.
FIRST, EACH = 64, 6
POSITIONS = 192
#: Of POSITIONS, so many are shared by linked texts.
LEAST = 20
#: Of the bits of the first CHECK bytes, so many differ at most in texts that are compared.
CHECK, CHECK_BITS = 24, 58
#: A block of a list has about so many members; so many are compared at one time, unless a block has more.
LIST_BLOCK = 1 << 16
CHUNK = 1 << 15
#: A block has about so many members, or so many shingles if these are fewer texts.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Different shingles that are counted at one time.
COLUMNS = 4096

#: The positions by which the texts of a list meet: each of the rest serves three lists, of different company.
_FURTHER = FIRST + (2 * np.arange(FIRST)[:, None] + np.array([0, 1, 22, 45, 74, 101])) % (POSITIONS - FIRST)


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64))


def fingerprint(shingles: np.ndarray) -> bytes:
    """The positional bytes of a shingle set's SimHash."""
    return signs(shingles, POSITIONS).tobytes()


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(x, words) for x in part.column(2).cast(pa.binary()).to_pylist()]
            made = [pa.array([class_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([fingerprint(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], names=["doc_id", "row", "class", "n", "bytes"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(x, words).tobytes() for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["class", "shingles"])

    return run


def tallies(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many positional bytes each row of x shares with each row of y."""
    out = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        out += a[:, None] == b[None]
    return out


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x shares with each set of y."""
    out = np.zeros((len(x), len(y)))
    if not len(x) or not len(y):
        return out
    left, right = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(left, right)
    sides = []
    for sets, values in ((x, left), (y, right)):
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        known = common[at] == values if len(common) else np.zeros(len(values), bool)
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[known], at[known]))
    for first in range(0, len(common), COLUMNS):
        dense = []
        for sets, (row, column) in zip((x, y), sides):
            inside = (column >= first) & (column < first + COLUMNS)
            part = np.zeros((len(sets), min(COLUMNS, len(common) - first)), np.float32)
            part[row[inside], column[inside] - first] = 1
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def _linked(table: pa.Table) -> pa.Table:
    """A spanning forest (a, b) of the links between two blocks of a list, or within one."""
    group, low, high = (table.column(c).to_numpy() for c in ("group", "low", "high"))
    names, sizes = table.column("class").to_numpy(), table.column("n").to_numpy()
    prints = _prints(table.column("bytes"))
    sets = table.column("shingles").to_pylist()
    x = np.flatnonzero(group == low)
    y = x if low[0] == high[0] else np.flatnonzero(group == high)
    near = tallies(prints[x], prints[y]) >= LEAST
    near &= 5 * np.minimum.outer(sizes[x], sizes[y]) >= FIFTHS * np.maximum.outer(sizes[x], sizes[y])
    if y is x:
        near &= np.tri(len(x), k=-1, dtype=bool)
    rows, columns = near.any(axis=1), near.any(axis=0)
    x, y, near = x[rows], y[columns], near[rows][:, columns]
    made = {n: np.frombuffer(sets[n], np.uint64) for n in {*x.tolist(), *y.tolist()}}
    shared = shared_counts([made[n] for n in x.tolist()], [made[n] for n in y.tolist()])
    i, j = np.nonzero(near & (5 * shared >= FIFTHS * (np.add.outer(sizes[x], sizes[y]) - shared)))
    labels = forest(np.arange(len(names)), x[i], y[j])
    at = np.flatnonzero(labels != np.arange(len(names)))
    return pa.table({"a": pa.array(names[at], pa.int64()), "b": pa.array(names[labels[at]], pa.int64())})


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _units(prints: np.ndarray) -> np.ndarray:
    """The lists of each fingerprint: position and byte."""
    return prints[:, :FIRST] + np.arange(0, FIRST << 8, 256)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(FIRST << 8, np.int64)
    for part in slices(batches):
        found += np.bincount(_units(_prints(part.column(1))).ravel(), minlength=len(found))
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["unit", "members"])


_POSTS = ["unit", "class", "further", *(f"check{k}" for k in range(CHECK // 8))]


def _posted(groups: np.ndarray):
    """Posts of classes: two blocks of a list (groups: how many blocks each has), further bytes and block, first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            prints = _prints(part.column(1))
            units = _units(prints).ravel()
            names = np.repeat(part.column(0).to_numpy(), FIRST)
            further = np.zeros((len(units), 8), np.uint8)
            further[:, :EACH] = prints[:, _FURTHER].reshape(-1, EACH)
            check = np.ascontiguousarray(prints[:, :CHECK]).view(np.int64)
            copies = groups[units]
            at = np.repeat(np.arange(len(units)), copies)
            other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            own = names[at] % copies[at]
            low, high = np.minimum(own, other), np.maximum(own, other)
            further = further[at]
            further[:, 7] = own != low
            columns = [units[at] << 40 | low << 20 | high, names[at], further.view(np.int64).ravel(), *check[at // FIRST].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_POSTS)

    return run


def _met(columns: list[np.ndarray]) -> pa.RecordBatch:
    """A spanning forest (a, b) of the candidates in whole lists, posts of which come in order of list and class.

    So b is the smallest class that a reaches there, mostly the same one in all lists that near copies share.
    """
    unit, names, further = columns[:3]
    further, check = further.view(np.uint8).reshape(-1, 8), np.stack(columns[3:], axis=1).view(np.uint64)
    within, side, numbers = (unit >> 20 & 0xFFFFF) == (unit & 0xFFFFF), further[:, 7], np.arange(len(unit))
    labels, dense, cut_up = numbers.copy(), np.cumsum(np.diff(unit, prepend=unit[:1]) != 0) << 8, not within.all()
    for e in range(EACH):
        key = dense + further[:, e]
        order = np.argsort(key, kind="stable")
        stops = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(key))
        left = np.repeat(stops, np.diff(stops, prepend=0)) - numbers
        first, distance = np.flatnonzero(left > 1), 1
        while len(first):
            a, b = order[first], order[first + distance]
            apart = labels[a] != labels[b]
            if cut_up:
                apart &= within[a] | (side[a] != side[b])
            a, b = a[apart], b[apart]
            near = np.bitwise_count(check[a] ^ check[b]).sum(axis=1, dtype=np.uint8) <= CHECK_BITS
            if near.any():
                labels = forest(labels, a[near], b[near])
            distance += 1
            first = first[left[first] > distance]
    at = np.flatnonzero(labels != numbers)
    return pa.RecordBatch.from_arrays([pa.array(names[at], pa.int64()), pa.array(names[labels[at]], pa.int64())], names=["a", "b"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, due = [], 0, CHUNK
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= due:
            whole = [np.concatenate(x) for x in zip(*held)]
            stop = int(np.searchsorted(whole[0], whole[0][-1]))
            if stop:
                yield _met([x[:stop] for x in whole])
            held, size = [[x[stop:] for x in whole]], size - stop
            due = size + CHUNK
    if size:
        yield _met([np.concatenate(x) for x in zip(*held)])


def candidates(classes: DataFrame, list_block: int = LIST_BLOCK) -> DataFrame:
    """Edges (a, b) between classes (class, bytes) that meet in the index; their components are those of all that do.

    What comes to the driver is the number of members of each list: FIRST times 256 at most.
    """
    groups = np.ones(FIRST << 8, np.int64)
    sizes = classes.select("class", "bytes").mapInArrow(_sizes, "unit long, members long").groupBy("unit").agg(F.sum("members").alias("members"))
    for unit, members in sizes.where(F.col("members") > list_block).collect():
        groups[unit] = -(-members // list_block)
    posts = classes.select("class", "bytes").mapInArrow(_posted(groups), ", ".join(f"{x} long" for x in _POSTS))
    met = posts.repartition("unit").sortWithinPartitions("unit", "class").mapInArrow(_meetings, "a long, b long").distinct()
    # of the smallest classes that a text reaches in its lists, the least is enough, and links the others
    least = F.min("b").over(Window.partitionBy("a"))
    met = met.select("a", "b", least.alias("least"))
    return met.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b")).distinct()


def links(prints: DataFrame, texts: DataFrame, words: int = WORDS, block: int = BLOCK, list_block: int = LIST_BLOCK) -> DataFrame:
    """Edges (a, b) between classes whose sets are similar enough; their components are those of all such pairs.

    prints: class, n, bytes, row; texts: row, text.
    """
    classes = cut(prints.where("n > 0").groupBy("class", "n", "bytes").agg(F.min("row").alias("row")), "classes")
    roots = components(candidates(classes, list_block)).withColumnRenamed("node", "class")
    met = cut(classes.join(roots, "class"), "met")
    # of the texts that meet none, few are shuffled
    texts = marked(texts, "row", met.select("row"), "meets").where("meets").select("row", "text")
    sets = texts.join(met.select("row", "class"), "row").select("class", "text").mapInArrow(_sets(words), "class long, shingles binary")
    # equal rows have equal texts
    sets = cut(sets.dropDuplicates(["class"]), "sets")
    units = met.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    groups = F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("class", F.lit(9)), F.col("groups")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    units = met.join(units.select("root", groups.alias("groups")), "root").select("root", "class", "n", "bytes", own.alias("group"), other.alias("other"))
    units = units.withColumns({"low": F.least("group", "other"), "high": F.greatest("group", "other")}).drop("other")
    units = units.join(sets, "class").select("root", "low", "high", "group", "class", "n", "bytes", "shingles")
    return cut(units.groupBy("root", "low", "high").applyInArrow(_linked, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, row and component for each row of docs (doc_id, row, text); row is a number for equal rows.

    Components are those of all links; their names are arbitrary numbers.  Null, empty and blank texts
    are one component.  Texts of any length are read whole; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text")
    prints = cut(rows.mapInArrow(_sketches(words), "doc_id long, row long, class long, n long, bytes binary"), "sketches")
    roots = components(links(prints, rows.select("row", "text"), words, block))
    return prints.join(roots, F.col("class") == F.col("node"), "left").select("doc_id", "row", F.coalesce("root", "class").alias("component"))
