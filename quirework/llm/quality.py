"""Quality classifier: a factorisation machine over hashed words, structure statistics and text lengths.

Features of a text are its distinct words hashed to ``WORD_BUCKETS`` (together of length one) and, per statistic of
``STATISTICS``, the bin of ``BINS`` that its value falls in. Every feature has a weight and ``RANK`` latent factors;
all pairs interact through the inner products of their factors, summed in linear time as half of (square of the sum
minus sum of the squares).

The machine is fitted by AdaGrad on a bounded sample: the ``SAMPLE`` labelled rows whose doc_id hashes lowest. Only
their features (not their texts) meet in one task; the weights are a few MB and are broadcast. Scoring covers every
row. Null and empty texts are scored by their (empty) statistics. Without any labelled row every score is 0.5. Rows
whose label or doc_id is null are not learnt from, several labels of a document are learnt from in turn; repeated
rows each get their row; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import narrow
from .langid import fold

SAMPLE = 12_000
WORD_BUCKETS = 1 << 15
RANK = 8
EPOCHS = 12
RATE = 0.08
DECAY = 1e-5
CUT = 0.7

STATISTICS = ("length", "words", "word_length", "upper", "digits", "symbols", "distinct", "lines", "outside_ascii", "symbol_runs", "markup", "line_repeats")
BINS = 16
FEATURES = WORD_BUCKETS + len(STATISTICS) * BINS


def _kinds() -> np.ndarray:
    """Byte classes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 line end, 6 outside ASCII, 7 markup; 0 the rest."""
    t = np.zeros(256, dtype=np.uint8)
    t[33:127] = 4
    t[65:91], t[97:123], t[48:58], t[10], t[128:] = 1, 2, 3, 5, 6
    t[[35, 36, 37, 38, 42, 60, 62, 91, 93, 94, 95, 96, 123, 124, 125, 126]] = 7
    return t


KIND = _kinds()
NOT_LINE_END = np.arange(256) != 10


def statistics(w: words.Words, lines: words.Words) -> np.ndarray:
    """The statistics of each row of the slice, every one from 0 to 1."""
    n = len(w.counts)
    lens = np.zeros(n, dtype=np.int64)
    by_kind = np.zeros((n, 8))
    starts, ends = w.firsts[:-1], w.firsts[1:]
    letters = w.ends - w.starts
    kinds = KIND[w.data]
    cum = np.concatenate([np.zeros((1, 8), dtype=np.int64), np.cumsum(kinds[:, None] == np.arange(8)[None, :], axis=0, dtype=np.int64)]) if len(kinds) else np.zeros((1, 8), dtype=np.int64)
    twice = np.zeros(len(kinds) + 1, dtype=np.int64)
    if len(kinds) > 1:
        sym = (kinds == 4) | (kinds == 7)
        twice[2:] = np.cumsum(sym[1:] & sym[:-1])
    out = np.zeros((n, len(STATISTICS)))
    rows = np.repeat(np.arange(n), w.counts)
    pairs = np.unique(np.stack([rows.astype(np.uint64), w.hashes]), axis=1) if len(rows) else np.zeros((2, 0), dtype=np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=n)
    lrows = np.repeat(np.arange(n), lines.counts)
    lpairs = np.unique(np.stack([lrows.astype(np.uint64), lines.hashes]), axis=1) if len(lrows) else np.zeros((2, 0), dtype=np.uint64)
    ldistinct = np.bincount(lpairs[0].astype(np.int64), minlength=n)
    for r in range(n):
        if starts[r] == ends[r]:
            continue
        lo, hi = int(w.starts[starts[r]]), int(w.ends[ends[r] - 1])
        k = cum[hi] - cum[lo]
        size, count = hi - lo, int(w.counts[r])
        alpha = max(k[1] + k[2] + k[6], 1)
        out[r] = (np.log1p(size) / 16, np.log1p(count) / 14, letters[starts[r] : ends[r]].mean() / 24, k[1] / alpha, 4 * k[3] / size, 4 * k[4] / size, distinct[r] / count,
                  8 * k[5] / count, k[6] / size, 8 * (twice[hi] - twice[lo]) / size, 8 * k[7] / size, 1 - ldistinct[r] / max(lines.counts[r], 1))
    return np.clip(out, 0, 1)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row: feature numbers in order, and their values."""
    both = zip(words.word_slices(texts, words.NOT_SPACE), words.word_slices(texts, NOT_LINE_END, words.SAME))
    for w, lines in both:
        bins = np.minimum((statistics(w, lines) * BINS).astype(np.int64), BINS - 1) + WORD_BUCKETS + np.arange(len(STATISTICS)) * BINS
        firsts = w.firsts
        bucket = (w.hashes >> np.uint64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int64)
        for r in range(len(w.counts)):
            own = np.unique(bucket[firsts[r] : firsts[r + 1]])
            yield np.concatenate([own, bins[r]]), np.concatenate([np.full(len(own), 1 / np.sqrt(max(len(own), 1))), np.full(len(STATISTICS), 1 / np.sqrt(len(STATISTICS)))])


class Machine:
    """bias, weights (feature) and factors (feature, rank)."""

    def __init__(self, bias: float = 0.0, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.factors = np.random.default_rng(1).normal(0, 0.05, (FEATURES, RANK)) if factors is None else factors

    def margins(self, at: np.ndarray, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Scores before the logistic function, for rows that start at ``heads``."""
        v = self.factors[at] * x[:, None]
        total = np.add.reduceat(v, heads, axis=0)
        squares = np.add.reduceat((v * v).sum(axis=1), heads)
        return self.bias + np.add.reduceat(self.weights[at] * x, heads) + 0.5 * ((total * total).sum(axis=1) - squares)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, batch: int = 64) -> Machine:
        rng = np.random.default_rng(2)
        p = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = np.log(p / (1 - p))
        gw, gv, gb = np.full(FEATURES, 1e-3), np.full((FEATURES, RANK), 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                at, x = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                lens = np.array([len(rows[i][0]) for i in own])
                heads = np.cumsum(lens) - lens
                err = (1 / (1 + np.exp(-self.margins(at, x, heads))) - y[own]) / len(own)
                by = np.repeat(err, lens)
                v = self.factors[at]
                total = np.repeat(np.add.reduceat(v * x[:, None], heads, axis=0), lens, axis=0)
                used, where = np.unique(at, return_inverse=True)
                dw = np.bincount(where, by * x, len(used)) + DECAY * self.weights[used]
                full = by[:, None] * (x[:, None] * total - v * (x * x)[:, None])
                dv = np.stack([np.bincount(where, full[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * self.factors[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += err.sum() ** 2
                self.weights[used] -= RATE * dw / np.sqrt(gw[used])
                self.factors[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * err.sum() / np.sqrt(gb)
        return self


def sample(labels: DataFrame, label: str, size: int, mod: int, held: int) -> DataFrame:
    """(doc_id, y) of the ``size`` labelled learning rows whose doc_id hashes lowest."""
    rows = labels.where(fold("doc_id", mod) != held).where(f"{label} is not null")
    return rows.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(size)


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Machine:
    chosen = sample(labels, "quality", size, 4, 2)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float64()))],
                names=["doc_id", "y", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), b.column("at").to_pylist(), b.column("x").to_pylist())]
        rows.sort(key=lambda r: (r[0], r[1], r[2]))
        m = Machine()
        if not rows:
            m.factors[:] = 0
        else:
            m.fit([(np.array(a), np.array(x)) for _, _, a, x in rows], np.array([float(y) for _, y, _, _ in rows]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, FEATURES).astype(np.int32)), pa.array(np.append(m.bias, m.weights)), pa.array([[0.0] * RANK, *m.factors.tolist()], pa.list_(pa.float64()))],
            names=["feature", "weight", "factors"])

    rows = narrow(docs.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").mapInArrow(describe, "doc_id long, y int, at array<int>, x array<double>")
    got = rows.repartition(1).mapInArrow(fit, "feature int, weight double, factors array<double>").toArrow()
    order = np.argsort(got["feature"].to_numpy())
    weights = got["weight"].to_numpy()[order]
    factors = np.array(got["factors"].to_pylist())[order]
    return Machine(weights[0], weights[1:], factors[1:])


def predict(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            scores, own = [], []
            for f in features(batch.column("text")):
                own.append(f)
                if len(own) == 128:
                    scores += _scores(m, own)
                    own = []
            scores += _scores(m, own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return narrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double")


def _scores(m: Machine, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    if not rows:
        return []
    lens = np.array([len(a) for a, _ in rows])
    margins = m.margins(np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(lens) - lens)
    return (1 / (1 + np.exp(-margins))).tolist()


def report(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """One row per document: whether it was held out of learning, its score and the decision."""
    out = predict(docs, learn(docs, labels, size))
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
