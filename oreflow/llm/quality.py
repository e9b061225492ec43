"""A quality classifier: kernel ridge regression on document statistics, calibrated.

Random Fourier features approximate a Gaussian kernel over statistics of the whole text.  Every
partition sums its part of the normal equations, the sums make ridge weights, and isotonic
regression turns raw scores into probabilities.  It learns from labelled rows of its own, a fifth of them,
on which no weight was fitted.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, drop, ship, slices

#: At most so many labelled rows are fitted on, chosen by a hash of the id.
FIT_ROWS = 40_000
#: Random Fourier features.
COMPONENTS = 256
RIDGE = 1e-4
#: Of the labelled rows one in so many calibrates, and the others are fitted.
CALIBRATING = 5
#: Raw scores are counted in so many bins before isotonic regression.
BINS = 1000
#: Tasks whose sums meet at the driver.
SUM_TASKS = 16

_CLASSES = [
    lambda c: 97 <= c <= 122,
    lambda c: 65 <= c <= 90,
    lambda c: 48 <= c <= 57,
    lambda c: c in b" \t\r\n\f\v",
    lambda c: c == 10,
    lambda c: c in b".,",
    lambda c: c in b"!?",
    lambda c: c in b"|",
    lambda c: c in b"#$%&*+=<>@^_~\\/",
    lambda c: c in b"'\"()[]{}:;-`",
    lambda c: c >= 128,
    lambda c: c < 32 and c not in b"\t\n\r\f\v",
]
_CLASS = np.array([[bool(f(c)) for f in _CLASSES] for c in range(256)], np.float64)
#: How many statistics a text has.
SIZE = len(_CLASSES) + 12


def statistics(text: bytes | None) -> np.ndarray:
    """The statistics of a whole text; all zero for null and empty texts."""
    out = np.zeros(SIZE)
    if not text:
        return out
    n = len(text)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    rest = [np.log1p(n) / 12, 0, 0, 0, 0, 0, 0, 0, np.log1p(len(lines)) / 8, 0, 0, 0]
    if words:
        m = len(words)
        counts = Counter(words)
        rest[1] = np.log1p(m) / 10
        rest[2] = min(n / m, 40) / 10
        rest[3] = len(counts) / m
        rest[4] = max(counts.values()) / m
        rest[5] = sum(map(eq, words, words[1:])) / m
        rest[6] = sum(v for v in counts.values() if v == 1) / m
        rest[7] = sum(v for k, v in counts.items() if k.isupper()) / m
        rest[10] = sum(v for k, v in counts.items() if not k[-1:].isalnum() and k[-1] < 128 and k[-1] not in b".,") / m
        rest[11] = sum(v for k, v in counts.items() if not k[:1].isalnum() and k[0] < 128) / m
    if lines:
        rest[9] = 1 - len(set(lines)) / len(lines)
    out[: len(_CLASSES)] = np.sqrt(shares)
    out[len(_CLASSES) :] = rest
    return out


def isotonic(x: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centres, non-decreasing means) for ascending x with weights and sums."""
    blocks: list[list[float]] = []  # weight, sum, sum of weighted x
    for at, w, s in zip(x, weight, total):
        blocks.append([w, s, w * at])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


class Model:
    """Scores from statistics; constant if there was nothing to tell apart."""

    def __init__(self, constant: float = 0.5, mean=None, scale=None, seed: int = 5) -> None:
        self.constant, self.mean, self.scale = constant, mean, scale
        rng = np.random.default_rng(seed)
        # the kernel's width is the typical distance of standardised statistics
        self.directions = rng.normal(0, 1 / np.sqrt(SIZE), (SIZE, COMPONENTS))
        self.phases = rng.uniform(0, 2 * np.pi, COMPONENTS)
        self.weights = self.centres = self.means = None

    def components(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a one."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / COMPONENTS), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.components(x) @ self.weights

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """The calibrated score of each text, 0 to 1."""
        if self.weights is None or not texts:
            return np.full(len(texts), self.constant)
        return np.clip(np.interp(self.raw(np.stack([statistics(t) for t in texts])), self.centres, self.means), 0, 1)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x = [statistics(t).tolist() for t in part.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(x, pa.list_(pa.float64()))], names=["y", "calibrates", "x"])


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for part in slices(batches, 4096):
        yield part.column(0).to_numpy(zero_copy_only=False).astype(float), np.array(part.column(2).to_pylist()).reshape(-1, SIZE), part.column(1).to_numpy(zero_copy_only=False).astype(bool)


def _sums(make, only: bool | None = None):
    """A function for mapInArrow: the sum of make(y, x) over the task's rows, as the bytes of one array.

    only: the calibrating rows (True), the fitted rows (False) or all (None).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for y, x, calibrates in _arrays(batches):
            if only is not None:
                y, x = y[calibrates == only], x[calibrates == only]
            total = make(y, x) if total is None else total + make(y, x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _summed(rows: DataFrame, make, only: bool | None = None) -> np.ndarray | None:
    parts = rows.mapInArrow(_sums(make, only), "sums binary").collect()
    return np.sum([np.frombuffer(bytes(r["sums"])) for r in parts], axis=0) if parts else None


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """A model of labels.quality, learned from documents that are not held out.

    At most fit_rows labels are used; they alone are broadcast, so texts are not shuffled.  Labels
    other than 0 and 1 and labels without a document are ignored; repeated labels of a document each count.
    With one class or none the model is that class's score, or 0.5.  Where the fitted or the calibrating rows
    lack a class, as in tables of a few labels, all rows do both.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (crc_mod("id", 3) != 1))
    n = known.count()
    share = min(1.0, 0.9 * fit_rows / n) if n > fit_rows else 1.0
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))
    sample = known.where(place < int(share * (1 << 30))).limit(fit_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    calibrates = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(CALIBRATING)) == 0
    rows = cut(texts.select("y", calibrates.alias("calibrates"), "text").mapInArrow(_fit_rows, "y int, calibrates boolean, x array<double>"), "statistics")
    model = _fitted(rows.coalesce(SUM_TASKS))
    drop(rows)
    return model


def _fitted(rows: DataFrame) -> Model:
    """The model of rows (y, calibrates, x)."""
    first = lambda y, x: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])
    fitted, calibrating = (_summed(rows, first, x) for x in (False, True))
    if fitted is None:
        return Model()
    parts: tuple[bool | None, bool | None] = (False, True)
    if any(x[1] in (0, x[0]) for x in (fitted, calibrating)):
        parts, fitted = (None, None), fitted + calibrating
    n, ones = fitted[:2]
    if not n or ones in (0, n):
        return Model(float(ones / n) if n else 0.5)
    mean = fitted[2 : 2 + SIZE] / n
    deviation = np.sqrt(np.maximum(fitted[2 + SIZE :] / n - mean**2, 0))
    model = Model(float(ones / n), mean, np.where(deviation > 1e-6, deviation, 1.0))

    def normal(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = model.components(x)
        return np.vstack([z.T @ z, y @ z]).ravel()

    equations = _summed(rows, normal, parts[0]).reshape(-1, COMPONENTS + 1)
    gram, right = equations[:-1], equations[-1]
    model.weights = np.linalg.solve(gram + RIDGE * n * np.eye(len(gram)), right)

    def histogram(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = np.clip((model.raw(x) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)]).astype(float).ravel()

    count, good = _summed(rows, histogram, parts[1]).reshape(2, BINS)
    used = np.flatnonzero(count)
    model.centres, model.means = isotonic((used + 0.5) / BINS * 2 - 0.5, count[used], good[used])
    return model


_models: dict[bytes, Model] = {}


def _model(data: bytes) -> Model:
    if data not in _models:
        _models.clear()
        _models[data] = pickle.loads(data)
    return _models[data]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of each whole text.

    Null texts count as empty; an empty text has the score of its statistics; texts of any length are read
    whole.  A score of exactly 0.5 predicts 1.  Equal texts have equal scores, repeated rows are kept, a null id is
    not held out, an empty table gives no rows, other columns are not read.  Ids must be numbers.
    """
    ship(docs.sparkSession)
    data = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = _model(data).score(part.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(id_col, 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose score is at least that."""
    ship(docs.sparkSession)
    data, at = pickle.dumps(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            score = _model(data).score(part.column(at).cast(pa.binary()).to_pylist())
            yield part.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
