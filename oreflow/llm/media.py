"""Media columns: payloads as PNG images in binary columns, read back, checked and hashed.

A payload is an 8-bit greyscale image of `WIDTH` columns.  The file is signature, IHDR, a private
chunk with the payload's own length, IDAT (zlib) and IEND, each chunk with its crc32.  Reading tests
every checksum and undoes the five row filters with numpy.  The feature is a perceptual hash: the
image is averaged to 32 by 32, and the signs of its 64 lowest frequencies under a cosine transform,
against their median, are the bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT = 576
WIDTH = 576
PAD = 255
SIDE = 32
LOW = 8
#: Rows that are filtered at one time, and rows whose antidiagonals are undone together.
BLOCK = 4096
WAVE_ROWS = 512

_COSINE = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def payload(text: bytes | None) -> bytes:
    """A text's bytes, filled up with bytes 255 to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes([PAD]) * ((-len(text)) % UNIT or (0 if text else UNIT))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(image: np.ndarray, filters: np.ndarray | None) -> Iterator[np.ndarray]:
    """The filtered rows, each behind its filter type, in blocks of BLOCK rows; without filters all have type 0."""
    for at in range(0, len(image), BLOCK):
        block = image[at : at + BLOCK]
        rows = np.zeros((len(block), block.shape[1] + 1), np.uint8)
        rows[:, 1:] = block
        if filters is not None:
            rows[:, 0] = kinds = filters[at : at + BLOCK]
            above = np.zeros_like(block)
            above[1:] = block[:-1]
            if at:
                above[0] = image[at - 1]
            for kind in np.unique(kinds[kinds > 0]):
                own = kinds == kind
                left, up = np.zeros_like(block[own]), above[own]
                left[:, 1:] = block[own][:, :-1]
                corner = np.zeros_like(up)
                corner[:, 1:] = up[:, :-1]
                rows[own, 1:] -= _expected(int(kind), left, up, corner)
        yield rows


def _expected(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a filter type expects for samples with these neighbours."""
    if kind < 3:
        return left if kind == 1 else up
    a, b, c = left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)
    if kind == 3:
        return ((a + b) >> 1).astype(np.uint8)
    p = a + b - c
    near_a, near_b, near_c = abs(p - a), abs(p - b), abs(p - c)
    return np.where((near_a <= near_b) & (near_a <= near_c), left, np.where(near_b <= near_c, up, corner))


def encode_png(samples: bytes, n_bytes: int, width: int = WIDTH, level: int = 6, filters: np.ndarray | None = None) -> bytes:
    """A PNG file of samples (whole rows of `width`); filters gives each row's filter type, 0 without."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    pack = zlib.compressobj(level)
    data = b"".join([*(pack.compress(rows.tobytes()) for rows in _filtered(image, filters)), pack.flush()])
    head = struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"nbYt", struct.pack(">Q", n_bytes)) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def row_filters(samples: bytes, width: int = WIDTH) -> np.ndarray:
    """For each row the type among none, left and above that leaves the least sum of absolute differences."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, width)
    out = np.zeros(len(image), np.uint8)
    for at in range(0, len(image), BLOCK):
        block = image[at : at + BLOCK]
        left, above = block.copy(), block.copy()
        left[:, 1:] -= block[:, :-1]
        above[1:] -= block[:-1]
        if at:
            above[0] -= image[at - 1]
        out[at : at + BLOCK] = np.argmin([np.minimum(x, -x).sum(axis=1, dtype=np.int64) for x in (block, left, above)], axis=0)
    return out


def smallest_png(samples: bytes, n_bytes: int) -> bytes:
    """The smaller file of two: without filters, and with those of row_filters."""
    return min(encode_png(samples, n_bytes), encode_png(samples, n_bytes, filters=row_filters(samples)), key=len)


def _waves(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The samples of filtered rows of any types; above is the row before them.

    A sample needs those to its left, above and above left: all samples of one antidiagonal are undone
    at once.  Row n is shifted by n places, so that an antidiagonal is one line of the shifted block.
    """
    n, width = rows.shape
    shifted = np.zeros((width + n + 1, n + 1), np.uint8)  # one line and one column of zeros come first
    at = np.arange(n)
    columns = np.arange(width)
    shifted[columns + 1, 0] = above
    raw = np.zeros((width + n, n), np.uint8)
    for r in range(n):
        raw[r : r + width, r] = rows[r]
    groups = [(kind, at[kinds == kind]) for kind in np.unique(kinds)]
    for wave in range(width + n - 1):
        # column 0 of shifted is the row above, which lies one place earlier than row 0
        for kind, own in groups:
            own = own[max(0, np.searchsorted(own, wave - width + 1)) : np.searchsorted(own, wave, side="right")]
            if not len(own):
                continue
            value = raw[wave, own]
            if kind:
                left, up, corner = shifted[wave + 1, own + 1], shifted[wave + 1, own], shifted[wave, own]
                value = value + _expected(int(kind), left, up, corner)
            shifted[wave + 2, own + 1] = value
        # what lies left of a row's first sample is zero
        if wave + 1 < n:
            shifted[wave + 2, wave + 2 :] = 0
    return np.stack([shifted[r + 2 : r + 2 + width, r + 1] for r in range(n)])


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """The samples of filtered rows, whose first byte is the filter type, by numpy alone.

    Runs of types 0 to 2 are undone at once; the rest in blocks, an antidiagonal at a time.
    """
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter type")
    stops = np.flatnonzero(np.diff(np.where(kinds > 2, 3, kinds))) + 1
    for a, b in zip([0, *stops.tolist()], [*stops.tolist(), len(out)]):
        kind = kinds[a] if b > a else 0
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            for at in range(a, b, WAVE_ROWS):
                end = min(b, at + WAVE_ROWS)
                out[at:end] = _waves(kinds[at:end], out[at:end], out[at - 1] if at else np.zeros(out.shape[1], np.uint8))
    return out


def decode_png(data: bytes) -> tuple[np.ndarray, int | None]:
    """The samples (rows, columns) and the payload's own length; ValueError for a damaged or other file."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, size, own, parts, ended = 8, None, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("a chunk is cut short")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            width, height, depth, colour, method, filtering, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, method, filtering, interlace) != (8, 0, 0, 0, 0):
                raise ValueError("only 8-bit greyscale without interlace is read")
            size = height, width + 1
        elif kind == b"nbYt":
            (own,) = struct.unpack(">Q", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif not kind[0] & 32:
            raise ValueError(f"unknown critical chunk {kind!r}")
    if not ended or size is None:
        raise ValueError("a chunk is missing")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if len(raw) != size[0] * size[1]:
        raise ValueError("image data of another size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(size)), own


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: the signs of the 8 by 8 lowest frequencies of the image averaged to 32 by 32."""
    edges = [np.arange(SIDE) * n // SIDE for n in image.shape]
    sums = np.add.reduceat(np.add.reduceat(image, edges[1], axis=1, dtype=np.int64), edges[0], axis=0)
    areas = np.outer(*(np.maximum(np.diff([*e, n]), 1) for e, n in zip(edges, image.shape)))
    low = _COSINE @ (sums / areas) @ _COSINE.T
    rest = low.ravel()[1:]
    bits = np.concatenate([[low[0, 0] > 0], rest > np.median(rest)])
    return np.packbits(bits).tobytes().hex()


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        files = []
        for text in part.column(1).cast(pa.binary()).to_pylist():
            files.append(smallest_png(payload(text), len(text or b"")))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], names=["doc_id", "media"])


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for part in slices(batches):
        rows = []
        for data in part.column(1).to_pylist():
            image, own = decode_png(data)
            samples = image.tobytes()
            rows.append((own, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(image)))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[x.split()[0] for x in _FEATURES.split(", ")])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: each text's payload as a PNG file in a binary column.

    Null and empty texts give one row of bytes 255; a text of any length is one image, filtered in blocks, so
    memory is a few times the text.  Rows are independent: equal texts give equal files, repeated rows and
    null ids are kept, an empty table gives no rows, other columns are not read.  Ids must be numbers.
    """
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_media, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Sizes, digests and cosine hash of the files of media_column, from the stored bytes; a damaged file fails the job."""
    ship(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_features, _FEATURES)
