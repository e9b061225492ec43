"""SentencePiece BPE encoding by a prefix table, and decoding.

A merge-type encoder has one encoding for every prefix of a segment, and each prefix's encoding ends
with one token.  The table stores that token's length for every prefix: an automaton reports the
vocabulary's pieces that end there, and the right one is the piece that may stand behind the last
token of the prefix before it.  Two tokens may stand together if merging their characters gives
just these two.  The ids are recovered backwards from the last prefix.

A text becomes one blank mark and the text with marks for blanks.  No piece has a mark behind
another character, so a text falls into segments: marks, then characters without marks.  Segments
that recur are encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .tokens import Parts

MARK = "▁"
_SEGMENTS = re.compile(" *[^ ]+| +")
#: Remembered tests of token pairs.
PAIRS = 300_000


class PrefixTable:
    """A BPE model's vocabulary for encoding and decoding without the library."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("the identity normalizer with a dummy prefix is needed")
        pieces = list(model.pieces)
        if any(x.type == 4 for x in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.ids = {x.piece: n for n, x in enumerate(pieces) if x.type == 1}
        if any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("a piece crosses a blank mark")
        self.scores = {x.piece: x.score for x in pieces if x.type == 1}
        self.byte_ids = {int(x.piece[1:-1], 16): n for n, x in enumerate(pieces) if x.type == 6}
        #: What a piece decodes to; control pieces to nothing.
        self.texts = [
            x.piece.replace(MARK, " ").encode() if x.type == 1 else bytes([int(x.piece[1:-1], 16)]) if x.type == 6 else b" \xe2\x81\x87 " if x.type == 2 else b""
            for x in pieces
        ]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for x in self.ids:
            if len(x) > 1 and self.merged(x) == [x]:
                self.automaton.add_word(x, x)
        self.automaton.make_automaton()
        self.segments = Parts(120_000)

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text: the best-scored neighbours are merged first, of equals the leftmost."""
        tokens = list(text)
        while True:
            best, at = None, -1
            for n in range(len(tokens) - 1):
                score = self.scores.get(tokens[n] + tokens[n + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, n
            if best is None:
                return tokens
            tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right stay two tokens when they stand together."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return found

    def tokens(self, segment: str) -> list[str]:
        """The tokens of one segment, by its prefix table."""
        pairs, compatible = self.pairs, self.compatible
        last = [""] * (len(segment) + 1)
        size, ends = 0, iter(self.automaton.iter(segment))
        end, piece = next(ends, (-1, ""))
        for n, char in enumerate(segment):
            size = n + 1
            found = ""
            while end == n:
                if not found:
                    before = last[size - len(piece)]
                    if not before:
                        if size == len(piece):
                            found = piece
                    else:
                        fits = pairs.get((before, piece))
                        if fits or fits is None and compatible(before, piece):
                            found = piece
                end, piece = next(ends, (-1, ""))
            last[size] = found or char
        out = []
        while size:
            out.append(last[size])
            size -= len(last[size])
        return out[::-1]

    def piece_ids(self, segment: str) -> list[int]:
        """The ids of one segment; characters without a piece fall back to their bytes."""
        out: list[int] = []
        for x in self.tokens(segment):
            n = self.ids.get(x)
            if n is None:
                out += map(self.byte_ids.__getitem__, x.encode())
            else:
                out.append(n)
        return out

    def _made(self, parts: list[str]) -> list[tuple[str, int, bytes]]:
        out = []
        for x in parts:
            ids = self.piece_ids(x.replace(" ", MARK))
            out.append((",".join(map(str, ids)), len(ids), self.raw(ids)))
        return out

    def segmented(self, text: str) -> list[tuple[str, int, bytes]]:
        """For each segment of a text: its ids as decimal numbers, how many, and what they decode to."""
        text = " " + text.replace(MARK, " ")
        # blanks stand for marks here; a segment takes the blanks before it
        parts = _SEGMENTS.findall(text) if "  " in text or text[-1] == " " else [" " + x for x in text[1:].split(" ")]
        return self.segments.values(parts, self._made)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none."""
        return [int(x) for part in self.segmented(text) for x in part[0].split(",")] if text else []

    def raw(self, ids: list[int]) -> bytes:
        """The bytes of ids, with a blank for every mark."""
        return b"".join(map(self.texts.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the blank of the dummy prefix; bytes that are no UTF-8 are replaced."""
        return self.raw(ids).removeprefix(b" ").decode(errors="replace")


@lru_cache(1)
def prefix_table(path: str) -> PrefixTable:
    """One table for each worker process."""
    return PrefixTable(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for part in slices(batches):
            rows: list[tuple] = []
            for text in part.column(1).to_pylist():
                found = list(zip(*table.segmented(text))) if text else [(), (), ()]
                decoded = b"".join(found[2]).removeprefix(b" ")
                rows.append((sum(found[1]), hashlib.sha256(",".join(found[0]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for part in slices(batches):
            ids = [table.encode(x) for x in part.column(1).to_pylist()]
            cols = [pa.array(ids, pa.list_(pa.int32())), pa.array(map(table.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "ids", "decoded"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of each row; see digests."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    return _rows(docs, id_col, text_col).mapInArrow(_encoded(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and sha256 of the ids (decimal, joined by commas) and of the decoded text, for each row.

    Null and empty texts have no ids and decode to the empty text.  Rows are independent: repeated
    rows, null ids and any length are encoded alike; an empty table gives no rows; other columns are
    not read.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    return _rows(docs, id_col, text_col).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
