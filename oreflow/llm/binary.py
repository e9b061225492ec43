"""Token ids in a binary format of fixed-width bit packing, written and read back through Spark.

A shard holds the ids of consecutive documents, each id in the fewest bits that hold the vocabulary.
Ids are packed in blocks of BLOCK, which begin at whole bytes; their offsets stand in the header, so
any span of ids is read by unpacking its blocks alone, with numpy.  Layout, little-endian:

    4 bytes "OFTI", u2 version, u2 bits, u4 ids of a block, u4 documents, u4 blocks, u8 ids
    documents x u1 (1: the id is known), documents x i8 (doc_id), documents x u8 (its number of ids)
    (blocks + 1) x u8 (offsets of the blocks, and their end, from the first block)
    the blocks: bit j of id i is bit i * bits + j, the least of a byte first

Shards are rows of a Parquet table in the shared folder: Spark's committer keeps the shards of lost
or repeated tasks out, and any store that Spark writes to will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, ship, slices
from .tokens import encoder

MAGIC = b"OFTI"
HEADER = struct.Struct("<4sHHIIIQ")
BLOCK = 4096
#: Ids after which a shard ends, with the document that passes them.
SHARD_IDS = 1 << 19
END_ID = 2
#: Ids that are unpacked at one time when all documents are read.
SPAN = 1 << 16
#: Token parts of a generation that a worker remembers; more than elsewhere, as nothing else runs beside.
CACHE_PARTS = 1_000_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) one behind the other in so many bits each.

    Eight ids fill `bits` whole bytes, so all groups of eight are packed at once, byte by byte.
    """
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    wide = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    wide.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(wide), bits), np.uint8)
    for n in range(8):
        first, shift = divmod(n * bits, 8)
        value = wide[:, n] << np.uint64(shift)
        for k in range(first, (n * bits + bits - 1) // 8 + 1):
            out[:, k] |= (value >> np.uint64(8 * (k - first))).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack_ids(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    size = -(-n * bits // 8)
    whole = np.zeros((-(-n // 8), bits), np.uint8)
    whole.reshape(-1)[:size] = np.frombuffer(data, np.uint8, size)
    out, mask = np.empty((len(whole), 8), "<u4"), np.uint64((1 << bits) - 1)
    for i in range(8):
        first, shift = divmod(i * bits, 8)
        value = np.zeros(len(whole), np.uint64)
        for k in range(first, (i * bits + bits - 1) // 8 + 1):
            value |= whole[:, k].astype(np.uint64) << np.uint64(8 * (k - first))
        out[:, i] = value >> np.uint64(shift) & mask
    return out.reshape(-1)[:n]


def write_shard(docs: list[tuple[int | None, bytes]], bits: int) -> bytes:
    """A shard of documents given by id and ids (little-endian unsigned 32-bit)."""
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    # a block's ids fill whole bytes, so blocks that are packed together begin at whole bytes
    packed = pack_ids(ids, bits)
    offsets = np.minimum(np.arange(-(-len(ids) // BLOCK) + 1, dtype="<u8") * (BLOCK * bits // 8), len(packed)).astype("<u8")
    return b"".join([
        HEADER.pack(MAGIC, 1, bits, BLOCK, len(docs), len(offsets) - 1, len(ids)),
        np.array([x is not None for x, _ in docs], np.uint8).tobytes(),
        np.array([x or 0 for x, _ in docs], "<i8").tobytes(),
        np.array([len(x) // 4 for _, x in docs], "<u8").tobytes(),
        offsets.tobytes(),
        packed,
    ])


class Shard:
    """Random access to a shard's bytes."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.bits, self.block, n_docs, n_blocks, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("no shard of this format")
        at = HEADER.size
        known = np.frombuffer(data, np.uint8, n_docs, at)
        ids = np.frombuffer(data, "<i8", n_docs, at := at + n_docs)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known)]
        self.lengths = np.frombuffer(data, "<u8", n_docs, at := at + 8 * n_docs)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * n_docs)
        self.data, self.first = memoryview(data), at + 8 * (n_blocks + 1)
        if self.first + int(self.offsets[-1]) != len(data):
            raise ValueError("the shard is cut short")

    def read(self, start: int, length: int) -> np.ndarray:
        """So many ids from a place in the shard; only their blocks are unpacked."""
        if start < 0 or length < 0 or start + length > self.n_ids:
            raise IndexError("outside the shard")
        if not length:
            return np.zeros(0, "<u4")
        a, b = start // self.block, -(-(start + length) // self.block)
        data = self.data[self.first + int(self.offsets[a]) : self.first + int(self.offsets[b])]
        if self.bits * self.block % 8:
            raise ValueError("blocks must end at whole bytes")
        n = min(b * self.block, self.n_ids) - a * self.block
        return unpack_ids(data, self.bits, n)[start - a * self.block :][:length]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard and ids of each document; spans of documents are read by their places."""
        start, at, held = 0, 0, np.zeros(0, "<u4")
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            if start + n > at + len(held):
                at, held = start, self.read(start, min(max(n, SPAN), self.n_ids - start))
            yield doc_id, start, held[start - at : start - at + n]
            start += n


def _written(path: str, spaced: bool, bits: int, shard_ids: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number, before = encoder(path, spaced, CACHE_PARTS).encode, TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = (task, number, before, size, write_shard(held, bits))
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "number", "before", "n_ids", "shard"]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], names=names)

        for piece in slices(batches):
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).cast(pa.binary()).to_pylist()):
                ids = encode(text) + end
                held.append((doc_id, ids))
                size += len(ids) // 4
                if size >= shard_ids:
                    yield flush()
                    number, before, held, size = number + 1, before + size, [], 0
        if held:
            yield flush()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    vocabulary: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    spaced: bool = True,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode every text, in ascending order of doc_id (null first; equal ids by their text's hash), to shards at path.

    vocabulary is the tokenizer's, and at least END_ID + 1; it decides how many bits an id has.  Null and empty
    texts have the end id alone; a text of any length is in one shard.  Repeated rows are written as often as they
    occur; other columns are not read; an empty table gives no shards.  Ids must be numbers.
    Texts are dealt by range before they are encoded, so ids are made once and never shuffled.  Packed
    ids hardly compress, so the table is not compressed.
    """
    ship(docs.sparkSession)
    file = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    if vocabulary is None:
        vocabulary = max(END_ID + 1, encoder(file, spaced, 1).tokenizer.get_vocab_size())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = [F.col("doc_id").asc(), F.xxhash64("text").asc()]
    (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_written(file, spaced, bits_for(vocabulary), shard_ids), "part int, number int, before long, n_ids long, shard binary")
        .write.option("compression", "none").parquet(path)
    )


def _read(names: list[str], types: list[pa.DataType], last):
    """Rows of doc_id, start, n_tokens and last(ids) for the documents of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1):
            start, shard = piece.column(0)[0].as_py(), Shard(piece.column(1)[0].as_py())
            rows = [(d, start + at, len(ids), last(ids)) for d, at, ids in shard.documents()]
            for a in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 4096]), types)], names=names)

    return run


def read_tokens(spark, path: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids before the document in all shards), n_tokens and ids, from the shards at path.

    ids are bytes of little-endian unsigned 32-bit numbers; digests gives their crc32 instead.
    What is broadcast is one row for each task that wrote, however many documents there are.
    """
    shards = spark.read.parquet(path)
    tasks = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = tasks.select("part", earlier.alias("first"))
    placed = shards.join(F.broadcast(firsts), "part").select((F.col("first") + F.col("before")).alias("start"), "shard")
    name, kind, last = ("ids_crc32", pa.int64(), zlib.crc32) if digests else ("ids", pa.binary(), np.ndarray.tobytes)
    read = _read(["doc_id", "start", "n_tokens", name], [pa.int64(), pa.int64(), pa.int64(), kind], last)
    return placed.mapInArrow(read, f"doc_id long, start long, n_tokens long, {name} {'long' if digests else 'binary'}")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write docs to new shards in the shared folder and return what read_tokens finds there, as digests."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path, digests=True)
