"""Packing of token pieces into training windows by Karmarkar-Karp multiway differencing.

Documents are cut into pieces of at most `piece` tokens.  About `group_windows` windows' worth of
pieces form a group, within the task that read them: no shuffle.  For k windows each piece starts as
a partial partition with one filled window.  The two partial partitions of the largest imbalance are
merged again and again, the fullest windows of one with the emptiest of the other, until one is
left.  If its fullest window exceeds the capacity, the group is packed anew with one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .tokens import encoder

CAPACITY = 4096
PIECE = 512
GROUP_WINDOWS = 256
#: Of a group's windows so much is meant to be filled, so that differencing seldom needs one more.
FILL = 0.998
END_ID = 2

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indexes of sizes in k windows of near-equal sums (windows may be empty)."""
    # a partial partition: -imbalance, a number that breaks ties, its windows as (sum, members), fullest first
    heap = [(-size, n, [(size, n)]) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        # the emptiest windows of a take the fullest of b
        both = a + b[:free] if free else list(a)
        for n, (size, members) in enumerate(b[free:]):
            at = len(a) - 1 - n
            both[at] = (both[at][0] + size, (both[at][1], members))
        both.sort(key=lambda x: -x[0])
        heapq.heappush(heap, (both[-1][0] * (len(both) == k) - both[0][0], turn, both))
        turn += 1
    out = []
    for _, members in heap[0][2] if heap else []:
        found, open_ = [], [members]
        while open_:
            x = open_.pop()
            if isinstance(x, tuple):
                open_ += x
            else:
                found.append(x)
        out.append(sorted(found))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The indexes of sizes (each at most capacity) in windows of at most capacity, as few as differencing needs."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[x] for x in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def pack_group(docs: list[tuple], capacity: int, piece: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (number of the document, start, length) for documents given by their spans (start, stop)."""
    cuts = [(n, a, min(piece, stop - a)) for n, (start, stop) in enumerate(docs) for a in range(start, stop, piece)]
    out = []
    for members in windows([x[2] for x in cuts], capacity):
        joined: list[tuple[int, int, int]] = []
        for n, a, length in (cuts[x] for x in members):
            if joined and joined[-1][0] == n and sum(joined[-1][1:]) == a:
                joined[-1] = (n, joined[-1][1], joined[-1][2] + length)
            else:
                joined.append((n, a, length))
        out.append(joined)
    return out


def _packed(path: str, spaced: bool, capacity: int, piece: int, group_windows: int, with_ids: bool):
    end = np.array([END_ID], "<u4").tobytes()

    def emit(held: list[tuple], base: int) -> pa.RecordBatch:
        rows: list[tuple] = []
        for number, window in enumerate(pack_group([(a, b) for _, _, a, b in held], capacity, piece)):
            offset = 0
            for n, start, length in window:
                doc_id, ids, _, _ = held[n]
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, base + number, offset, *([part] * with_ids)))
                offset += length
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
        types = [pa.int64()] * 7 + [pa.binary()] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced).encode
        # sequence numbers are the task's number and a count, the same in every attempt
        base, held, total, limit = TaskContext.get().partitionId() << 32, [], 0, int(capacity * group_windows * FILL)
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                ids = encode(text) + end
                at, n = 0, len(ids) // 4
                while at < n:
                    take = min(n - at, limit - total)
                    held.append((doc_id, ids, at, at + take))
                    at, total = at + take, total + take
                    if total == limit:
                        yield (out := emit(held, base))
                        base, held, total = base + out.num_rows, [], 0
        if held:
            yield emit(held, base)

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    piece: int = PIECE,
    group_windows: int = GROUP_WINDOWS,
    spaced: bool = False,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: where it starts there, and its sequence and offset there.

    with_ids adds the piece's ids as bytes (little-endian unsigned 32-bit).  Null and empty texts
    have the end id alone.  Repeated rows and null ids are packed like any other; texts longer than
    a group go on in the next one; an empty table gives no rows.  Other columns are not read.
    """
    if not 0 < piece <= capacity:
        raise ValueError("a piece must fit a window")
    ship(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = SCHEMA + ", ids binary" * with_ids
    return rows.mapInArrow(_packed(path, spaced, capacity, piece, group_windows, with_ids), schema)
