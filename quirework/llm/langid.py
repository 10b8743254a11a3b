"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every n-gram of 1 to 4 letters, hashed to ``BUCKETS``, are summed per language over all learning rows: in
each task as one array per language, then by a grouped sum. The log-probability matrix (languages x buckets, that is
its size bound) is broadcast, and batches are scored by gathering matrix rows at the n-grams of a text and summing
them per text. The score is the posterior of the winner.

Texts that are null or have no letter are ``und`` with score 0, as is everything when nothing can be learnt. Ties go
to the first language by name. Rows whose language or doc_id is null are not learnt from. Repeated rows each get
their row; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import narrow

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
HELD_AT_ONCE = 64  # languages counted in a task before it hands on what it has


def fold(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def _buckets(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at, h = chars.grams(codes, n)
    return at, (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of (text, lang); bucket -1 counts rows."""

    def rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, codes, lens in chars.code_slices(batch.column("text")):
                names = sorted(set(langs[lo:hi]))
                own = np.array([names.index(x) for x in langs[lo:hi]])
                by_place = np.repeat(own, lens)
                got = np.zeros((len(names), BUCKETS + 1), dtype=np.int64)
                got[:, 0] = np.bincount(own, minlength=len(names))
                for n in ORDERS:
                    at, b = _buckets(codes, n)
                    got[:, 1:] += np.bincount(by_place[at] * BUCKETS + b, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for i, name in enumerate(names):
                    held[name] = held[name] + got[i] if name in held else got[i]
                if len(held) > HELD_AT_ONCE:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return narrow(labelled.select("text", "lang")).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order of name, log priors, and the log-probability matrix (bucket, language)."""

    def __init__(self, table: pa.Table):
        self.langs = sorted(set(table["lang"].to_pylist()))
        which = {x: i for i, x in enumerate(self.langs)}
        c = np.zeros((BUCKETS + 1, len(self.langs)))
        c[table["bucket"].to_numpy() + 1, [which[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
        self.prior = np.log(np.maximum(c[0], 1) / max(c[0].sum(), 1))
        c = c[1:] + SMOOTHING
        self.logs = np.log(c / c.sum(axis=0)).astype(np.float32)


def learn(docs: DataFrame) -> Model:
    rows = docs.where(fold("doc_id", 4) != 2).where("lang is not null and text is not null")
    return Model(counts(rows).toArrow())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            preds, scores = [], []
            for _, _, codes, lens in chars.code_slices(batch.column("text")):
                logs = np.tile(m.prior, (len(lens), 1))
                starts = np.cumsum(lens) - lens
                for n in ORDERS if m.langs else ():
                    at, b = _buckets(codes, n)
                    for lo in range(0, len(at), step := max(1, (1 << 22) // max(1, len(m.langs)))):
                        row = np.searchsorted(starts, at[lo : lo + step], side="right") - 1
                        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                        logs[row[heads]] += np.add.reduceat(m.logs[b[lo : lo + step]], heads, axis=0, dtype=np.float64)
                for r, n in enumerate(lens):
                    if n == 1 or not m.langs:
                        preds.append("und")
                        scores.append(0.0)
                    else:
                        i = int(np.argmax(logs[r]))
                        preds.append(m.langs[i])
                        scores.append(float(1 / np.exp(logs[r] - logs[r][i]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return narrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: whether it was held out of learning, the predicted language and its posterior."""
    out = predict(docs, learn(docs))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
