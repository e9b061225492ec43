"""Language ID by a byte convolutional network, trained here with numpy.

Input is a window of WINDOW bytes of UTF-8 with ASCII digits, signs and white space as blanks.  Bytes are embedded;
filters of several widths slide over the window, each keeps its maximum, and a softmax over the
learned languages follows.  For scoring, embedding and filters fold into lookup tables of byte
pairs, so a whole text costs a few additions for each byte and filter.  A text is all its windows: their
log-probabilities are averaged with the windows' lengths as weights.

The windows to learn from are a bounded sample of each language, kept as a table.  An epoch is one job: each part
of the table, of about PART_WINDOWS windows, goes through the optimiser in a task of its own, and the
driver averages the parameters that the tasks return.  It never holds a window.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, drop, ship, slices

WINDOW = 256
#: Filter widths; each is summed from tables of pairs and single bytes.
WIDTHS = (2, 3, 4)
#: Filters of each width: as many as languages, between these bounds.
FILTERS = 10
MOST_FILTERS = 48
EMBEDDING = 8
#: At most so many documents of each language are fitted on, and so many windows and short passages of each document.
FIT_DOCUMENTS = 600
FIT_WINDOWS = 3
FIT_SHORT = 3
EPOCHS = 8
#: Windows that one task learns from in an epoch; more windows are more tasks.
PART_WINDOWS = 20_000
#: Of the windows every so many-th only tells when to stop: after PATIENCE epochs that did not gain a hundredth.
VALIDATION = 10
PATIENCE = 2

_LETTER = regex.compile(r"\p{L}")
#: What is no letter in ASCII becomes a blank, and A-Z becomes a-z.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))


def windows(text: bytes) -> np.ndarray:
    """A text's bytes, folded, with runs of blanks as one, in rows of WINDOW; the last is filled with zeros."""
    line = text.translate(_FOLD)
    if b"  " in line:
        line = b" ".join(line.split())
    rows = max(1, -(-len(line) // WINDOW))
    out = np.zeros(rows * WINDOW, np.uint8)
    out[: len(line)] = np.frombuffer(line, np.uint8)
    return out.reshape(rows, WINDOW)


def short_windows(rows: np.ndarray) -> np.ndarray:
    """A few passages of 12 to 100 bytes from a text's windows, filled with zeros, so that short texts are learned too."""
    out = np.zeros((FIT_SHORT, WINDOW), np.uint8)
    line = rows.ravel()
    rng = np.random.default_rng(len(line) + int(line[:WINDOW].sum()))
    for row in out:
        n = int(rng.integers(12, 101))
        start = int(rng.integers(0, max(1, np.count_nonzero(line) - n)))
        # from the next word on
        start += int(np.argmax(line[start : start + 40] == 32)) + 1 if start else 0
        part = line[start : start + n]
        row[: len(part)] = part
    return out


@dataclass
class Network:
    """The parameters: embedding, a kernel and bias for each width, and the softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def initial(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        filters = max(FILTERS, min(MOST_FILTERS, len(languages)))
        make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        kernels = [make(w * EMBEDDING, filters).reshape(w, EMBEDDING, filters) for w in WIDTHS]
        n = filters * len(WIDTHS)
        return cls(languages, rng.normal(0, 0.5, (256, EMBEDDING)), kernels, [np.zeros(filters) for _ in WIDTHS], make(n, len(languages)), np.zeros(len(languages)))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, *self.biases, self.out, self.out_bias]

    def _forward(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Pooled filters, where each has its maximum, and log-probabilities.

        A filter's value is a sum over its places of what a byte contributes there, so each place is a
        table of 256 bytes.
        """
        pooled, where = [], []
        for w, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            y = sum((self.embedding @ kernel[k]).T[:, rows[:, k : WINDOW - w + 1 + k]] for k in range(w))  # filter, window, place
            at = y.argmax(axis=2)
            pooled.append(np.maximum(np.take_along_axis(y, at[:, :, None], 2)[:, :, 0].T + bias, 0))
            where.append(at.T)
        h = np.concatenate(pooled, axis=1)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return h, where, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def loss(self, rows: np.ndarray, labels: np.ndarray) -> float:
        """The summed cross-entropy over windows."""
        return -sum(float(self._forward(rows[a : a + 64])[2][np.arange(len(labels[a : a + 64])), labels[a : a + 64]].sum()) for a in range(0, len(rows), 64))

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean cross-entropy over windows and its gradient for each parameter."""
        n, each = len(rows), np.arange(len(rows))
        h, where, logs = self._forward(rows)
        dz = np.exp(logs)
        dz[each, labels] -= 1
        dz /= n
        dh = dz @ self.out.T * (h > 0)
        d_embedding, d_kernels, d_biases = np.zeros_like(self.embedding), [], []
        filters = len(self.biases[0])
        for number, (w, kernel) in enumerate(zip(WIDTHS, self.kernels)):
            d = dh[:, number * filters : (number + 1) * filters]
            d_kernel = np.zeros_like(kernel)
            for k in range(w):
                # by the byte that each filter's maximum has at its place k
                cell = np.take_along_axis(rows, where[number] + k, 1).astype(np.intp) * filters + np.arange(filters)
                d_table = np.bincount(cell.ravel(), d.ravel(), 256 * filters).reshape(256, filters)
                d_kernel[k] = self.embedding.T @ d_table
                d_embedding += d_table @ kernel[k].T
            d_kernels.append(d_kernel)
            d_biases.append(d.sum(axis=0))
        return float(-logs[each, labels].mean()), [d_embedding, *d_kernels, *d_biases, h.T @ dz, dz.sum(axis=0)]

    def tables(self) -> Scorer:
        """The network folded for scoring."""
        return Scorer(self)


class Scorer:
    """Log-probabilities of windows from lookup tables.  What is sent to workers is the network; tables are made there."""

    def __init__(self, network: Network) -> None:
        self.network, self.languages = network, network.languages
        single = [[(network.embedding @ k[n]).astype(np.float32) for n in range(len(k))] for k in network.kernels]
        (two, three, four), biases = single, [b.astype(np.float32) for b in network.biases]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        self.lookups = [pair(two[0] + biases[0], two[1]), pair(three[0] + biases[1], three[1]), three[2], pair(four[0] + biases[2], four[1]), pair(four[2], four[3])]
        self.out, self.bias = network.out.astype(np.float32), network.out_bias.astype(np.float32)

    def __reduce__(self):
        return Scorer, (self.network,)

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """One row of log-probabilities for each window."""
        pairs = rows[:, :-1].astype(np.intp) * 256 + rows[:, 1:]
        two, three, last, four, tail = self.lookups
        n = WINDOW
        h = np.concatenate([
            two[pairs].max(axis=1),
            (three[pairs[:, : n - 2]] + last[rows[:, 2:]]).max(axis=1),
            (four[pairs[:, : n - 3]] + tail[pairs[:, 2:]]).max(axis=1),
        ], axis=1)
        z = np.maximum(h, 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, score from 0 to 1) of each whole text; `und` and 0 for a text without letters."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        held, firsts, lengths, size = [], [], [], 0
        known = [n for n, x in enumerate(texts) if x and _LETTER.search(x.decode())]

        def flush() -> None:
            nonlocal held, firsts, lengths, size
            if not held:
                return
            rows = np.concatenate(held)
            # texts of any length go through in blocks
            logs = np.concatenate([self.log_probabilities(rows[a : a + 64]) for a in range(0, len(rows), 64)])
            weight = np.maximum((rows != 0).sum(axis=1), 1)[:, None]
            starts = np.cumsum([0, *lengths[:-1]])
            mean = np.add.reduceat(logs * weight, starts) / np.add.reduceat(weight, starts)
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for n, row in zip(firsts, p):
                out[n] = (self.languages[int(row.argmax())], min(1.0, float(row.max())))
            held, firsts, lengths, size = [], [], [], 0

        for n in known:
            rows = windows(texts[n])
            held.append(rows)
            firsts.append(n)
            lengths.append(len(rows))
            size += len(rows)
            if size >= 4096:
                flush()
        flush()
        return out


@dataclass
class Training:
    """A network and the state of its optimiser, as they go from epoch to epoch."""

    network: Network
    step: int = 0
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.first = self.first or [np.zeros_like(p) for p in self.network.parameters()]
        self.second = self.second or [np.zeros_like(p) for p in self.network.parameters()]

    def arrays(self) -> list[np.ndarray]:
        return [*self.network.parameters(), *self.first, *self.second]

    def epoch(self, rows: np.ndarray, labels: np.ndarray, seed: int, batch: int = 64, rate: float = 0.01) -> None:
        """Adam over shuffled windows; the same rows in the same order give the same network."""
        order = np.random.default_rng(seed).permutation(len(rows))
        for a in range(0, len(order), batch):
            self.step += 1
            at = order[a : a + batch]
            _, grads = self.network.gradients(rows[at], labels[at])
            for p, g, m, v in zip(self.network.parameters(), grads, self.first, self.second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def _epoch(data: bytes, number: int):
    """For applyInArrow: a part's (lang, windows) through one epoch of a pickled Training."""

    def run(table: pa.Table) -> pa.Table:
        state: Training = pickle.loads(data)
        at = {x: n for n, x in enumerate(state.network.languages)}
        pairs = sorted(zip(table.column("lang").to_pylist(), table.column("windows").to_pylist()))
        rows = np.concatenate([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, w in pairs])
        labels = np.concatenate([np.full(len(w) // WINDOW, at[lang]) for lang, w in pairs])
        kept = np.arange(len(rows)) % VALIDATION == VALIDATION - 1
        loss, judged = state.network.loss(rows[kept], labels[kept]), int(kept.sum())
        state.epoch(rows[~kept], labels[~kept], number)
        out = {"state": pa.binary(), "n": pa.int64(), "loss": pa.float64(), "judged": pa.int64()}
        values = (pickle.dumps(state), int((~kept).sum()), loss, judged)
        return pa.table({name: pa.array([x], kind) for (name, kind), x in zip(out.items(), values)})

    return run


def fit(samples: DataFrame, languages: list[str], epochs: int = EPOCHS, part_windows: int = PART_WINDOWS) -> Network:
    """A network learned from a table (lang, windows), as bytes of whole windows."""
    n = samples.agg(F.sum(F.octet_length("windows"))).first()[0] // WINDOW
    parts = -(-n // part_windows)
    dealt = samples.select(F.pmod(F.xxhash64("windows"), F.lit(parts)).alias("part"), "lang", "windows")
    state, best, idle = Training(Network.initial(languages)), math.inf, 0
    for number in range(epochs):
        made = dealt.groupBy("part").applyInArrow(_epoch(pickle.dumps(state), number), "state binary, n long, loss double, judged long").collect()
        made.sort(key=lambda r: bytes(r.state))
        # the loss is that of the state before this epoch
        loss = sum(r.loss for r in made) / max(1, sum(r.judged for r in made))
        idle = idle + 1 if loss > 0.99 * best else 0
        best = min(best, loss)
        if idle >= PATIENCE:
            break
        found, weight = [pickle.loads(bytes(r.state)) for r in made], np.array([r.n for r in made], float)
        state = found[0]
        state.step = max(x.step for x in found)
        for own, *others in zip(*(x.arrays() for x in found)):
            own[...] = np.average([own, *others], axis=0, weights=weight if weight.any() else None)
    return state.network


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        picked = []
        for text in part.column(1).cast(pa.binary()).to_pylist():
            rows = windows(text)
            # evenly over the whole text
            at = np.unique(np.linspace(0, len(rows) - 1, min(FIT_WINDOWS, len(rows))).astype(int))
            picked.append(rows[at].tobytes() + short_windows(rows).tobytes())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(picked, pa.binary())], names=["lang", "windows"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_DOCUMENTS) -> Scorer | None:
    """A scorer learned from documents that are not held out; None if no text has a language.

    Every language that occurs is learned.  The sample of each is bounded: about per_language of its documents,
    chosen by a hash of id and text, FIT_WINDOWS windows of each, spread over the text, and FIT_SHORT short
    passages; equal samples count once, so repeated rows and copies weigh as one.  Rows that repeat an id with
    another lang are each a document of their lang.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where((crc_mod("id", 4) != 2) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1 << 20))
    shares = [(lang, int(min(1, per_language / n) * (1 << 20))) for lang, n in counts.items()]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share long")
    chosen = known.join(F.broadcast(shares), "lang").where((place < F.col("share")) & F.col("text").isNotNull())
    # whole texts stay in their tasks; only windows move
    samples = cut(chosen.select("lang", "text").mapInArrow(_samples, "lang string, windows binary").distinct(), "windows")
    languages = sorted(r["lang"] for r in samples.select("lang").distinct().collect())
    scorer = fit(samples, languages).tables() if languages else None
    drop(samples)
    return scorer


_scorers: dict[bytes, Scorer] = {}


def _scorer(data: bytes) -> Scorer:
    if data not in _scorers:
        _scorers.clear()
        _scorers[data] = pickle.loads(data)
    return _scorers[data]


def _results(scorer: Scorer | None, texts: list[bytes | None]) -> list[tuple[str, float]]:
    return scorer.predict(texts) if scorer else [("und", 0.0)] * len(texts)


def predict(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each whole text.

    Null and empty texts, and texts without letters, are `und` with score 0, as are all if nothing
    could be learned.  Of equally likely languages the first by name is predicted; texts of any length are
    read whole.  Rows are independent: equal texts have equal predictions; a null id is not held out; an
    empty table gives no rows; other columns are not read.  Ids must be numbers.
    """
    ship(docs.sparkSession)
    data = pickle.dumps(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lang, score = zip(*_results(_scorer(data), part.column(2).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, scorer: Scorer | None, text_col: str = "text", least: float = 0.4) -> DataFrame:
    """The rows of docs, all their columns, whose language is known with at least that score.

    Texts without letters go, and texts in which no language prevails.
    """
    ship(docs.sparkSession)
    data, at = pickle.dumps(scorer), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = _results(_scorer(data), part.column(at).cast(pa.binary()).to_pylist())
            yield part.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
