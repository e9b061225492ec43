"""SimHash near-duplicates: word-shingle fingerprints joined through a byte-position inverted index.

Method.  A 64-bit fingerprint has eight positional bytes.  Fingerprints that differ in at most two
bits share at least six of them: the guaranteed minimum.  A posting list for one byte would hold
1/256 of the corpus whatever its size, so each of the 21 kinds of lists here stands for five positions
and their bytes (40 bits).  The 21 sets of positions are chosen so that any six positions hold at least two of
them and any five at most one.  The tally of a pair is how many positional bytes its common lists
cover: all it shares if these are six or more, never more than it shares.  Pairs with a tally of six are
retained and verified bit by bit.

Equal fingerprints are one entry of the index, however many documents have them.  A list of five
bytes leaves 24 bits open, of which two may differ, so four of their six half bytes agree.  Within a
list, entries therefore meet by four half bytes, where at most 256 fingerprints can meet: the
pairs grow with the entries, not with the square of a list, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, ship, slices

SEED = 42
#: Differing bits of linked fingerprints; as many positional bytes may differ, of POSITIONS.
MAX_BITS = 2
POSITIONS = 8

_MIX = np.uint64(0xD6E8FEB86659FD93)


def _choices(max_bits: int) -> list[tuple[int, ...]]:
    """The sets of positions that lists stand for, each of one position fewer than linked fingerprints share.

    Any positions that linked fingerprints may share hold two sets at least, and so are covered.  For two
    bits the left-out threes are the lines of two Fano planes over positions 0 to 6, and the neighbours
    there with position 7: every two positions are in two or three of them.
    """
    if max_bits == 2:
        out = [{(x + turn) % 7 if x < 7 else 7 for x in line} for line in ((0, 1, 3), (0, 2, 3), (0, 1, 7)) for turn in range(7)]
        return [tuple(x for x in range(POSITIONS) if x not in o) for o in out]
    return list(combinations(range(POSITIONS), POSITIONS - 1 - max_bits))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(choice: tuple[int, ...]) -> int:
    """The bits of the bytes at the positions of a choice."""
    return sum(255 << (8 * x) for x in choice)


def _finer(choice: tuple[int, ...], max_bits: int) -> list[int]:
    """The masks by which entries of a list meet: its bytes and all but max_bits of the half bytes that it leaves open."""
    rest = [15 << (4 * n) for n in range(2 * POSITIONS) if n // 2 not in choice]
    return [_signed(_mask(choice) + sum(x)) for x in combinations(rest, len(rest) - max_bits)]


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """The 64-bit hash of each shingle of a text, in the text's order; none for a text without words.

    A-Z are lower-cased; words are runs of bytes that are not ASCII white space; a text of fewer
    words than a shingle is one shingle.
    """
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: len(found) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of a text's shingles, as a signed 64-bit number; a text without words has fingerprint zero."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@lru_cache(4)
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signs(hashes: np.ndarray, positions: int) -> np.ndarray:
    """SimHash of 64-bit hashes over any multiple of eight positional bytes; of none, all bits are zero.

    Each eight bytes are the signs of another hash of the hashes.  A bit that exactly half of them set is 0.
    """
    ones = np.zeros(8 * positions, np.int64)
    # sums of at most 255 bits are bytes
    for a in range(0, len(hashes), 255):
        x = hashes[a : a + 255, None] * _factors(positions // 8)
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([fingerprint(x, words) for x in texts], pa.int64())], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (signed 64-bit) for each row; other columns are not read."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The pairs (a, b) of distinct fingerprints fp that differ in at most max_bits (0 to 3) bits, a < b."""
    if not 0 <= max_bits <= 3:
        raise ValueError("at most three bits may differ")
    choices, fp = _choices(max_bits), F.col("fp")
    of = lambda values: F.element_at(F.array(*values), F.col("list") + 1)
    posts = prints.select("fp", F.posexplode(F.array(*(fp.bitwiseAND(F.lit(_signed(_mask(x)))) for x in choices))).alias("list", "bytes"))
    # lists of one entry make no pairs
    shared = posts.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1").select("list", "bytes")
    met = posts.join(shared, ["list", "bytes"]).select("list", "fp")
    finer = of(F.array(*(F.lit(m) for m in _finer(x, max_bits))) for x in choices)
    met = cut(met.select("list", "fp", F.posexplode(F.transform(finer, lambda m: fp.bitwiseAND(m))).alias("part", "bytes")), "met")
    key = ["list", "part", "bytes"]
    pairs = met.withColumnRenamed("fp", "a").join(met.withColumnRenamed("fp", "b"), key).where("a < b")
    positions = of(F.lit(sum(1 << p for p in x)) for x in choices)
    tallied = pairs.select("a", "b", positions.alias("positions")).groupBy("a", "b").agg(F.bit_count(F.bit_or("positions")).alias("tally"))
    retained = tallied.where(F.col("tally") >= POSITIONS - max_bits)
    return retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) for each row.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other; a text of any
    length is read whole.  A bit that exactly half of the shingles set is 0.  Repeated rows come out as often as they come in.  Null ids are kept and never name a component,
    unless no id of the component is known: then component_id is null.  An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, max_bits))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = cut(rooted.join(named, "root").select("fp", "component_id"), "members")
    return prints.join(members, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
