"""Toxicity from the nearest labelled examples, by TF-IDF cosine over chosen terms, exact over these, with block-max inverted indexes.

Terms are the words of a text and the character 5-grams of its words. ``TERMS`` of them are chosen by their
chi-square with the label over the examples, among those that speak for toxicity: more common among toxic examples,
and in at most ``STOP`` of the others (the rest is taken for stop words). A text's vector holds (1 + log count) x idf of its chosen terms, at length
one. The examples are a bounded sample: per label the ``EXAMPLES`` learning rows whose doc_id hashes lowest. Their
vectors make an inverted index whose postings are cut into blocks of examples; per term and block the largest weight
bounds what the block can reach, and blocks are scored, best bound first, until no bound beats the ``NEAREST``-th
cosine found. Pruning is safe, so the neighbours are exact.

Neighbours vote with their cosine squared, next to a prior of one vote; each vote counts for as many labelled rows as
its example stands for. A logistic curve fitted on the examples, each voted on by the others, calibrates the votes. Texts with no chosen term, null and empty texts among them,
share one vector-less vote: the share of toxic rows among such examples. Without labelled rows every score is 0.

``evidence`` names the nearest examples (doc_id, cosine, label). Ties in cosine go to the smaller doc_id. Rows whose
label or doc_id is null are not learnt from; a document labelled twice is two examples; repeated rows each get their
row. Columns beside doc_id and text are not looked at and pass unchanged through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chars
from .common import cut_lineage, narrow
from .langid import fold
from .words import mix

EXAMPLES = 3000  # per label
TERMS = 1500
STOP = 0.05
LEAST_EXAMPLES = 5  # a term must occur in so many examples
GRAM = 5
BLOCK = 64
NEAREST = 15
CUT = 0.5


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and one-past-last places of the words in the code points, and their hashes."""
    inside = (codes != 32) & (codes != 0)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    powers = np.multiply.accumulate(np.concatenate([[1], np.full(max(int(lens.max()) - 1, 0), 0x5851F42D4C957F2D)]).astype(np.uint64))
    h = np.add.reduceat(codes[inside].astype(np.uint64) * powers[at], np.cumsum(lens) - lens)
    return starts, ends, mix(h ^ lens.astype(np.uint64), 77)


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each term occurrence in order, its hash); rows count from the first."""
    for lo, hi, codes, lens in chars.code_slices(texts):
        starts = np.cumsum(lens) - lens
        place, _, h = _words(codes)
        at, g = chars.grams(codes, GRAM)
        spans = np.convolve((codes == 32).astype(np.int32), np.ones(GRAM - 2, dtype=np.int32), "valid") if len(codes) >= GRAM else np.zeros(0, dtype=np.int32)
        one_word = spans[at + 1] == 0 if len(at) else np.zeros(0, dtype=bool)
        at, g = at[one_word], g[one_word]
        where = np.concatenate([place, at])
        yield lo, hi, np.searchsorted(starts, where, side="right") - 1, np.concatenate([h, mix(g, 78)])


def _counted(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, value) in order, and how often each occurs."""
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    heads = np.flatnonzero(new)
    return row[heads], value[heads], np.diff(np.append(heads, len(row)))


def examples(labels: DataFrame, size: int) -> DataFrame:
    """(doc_id, y): per label the ``size`` learning rows whose doc_id hashes lowest."""
    rows = labels.where(fold("doc_id", 5) != 0).where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("y"))
    some = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    return some[0].unionAll(some[1])


def chosen_terms(rows: DataFrame, n: dict[int, int], most: int) -> DataFrame:
    """(term, idf) of the terms that say most about the label of the example rows (text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo, _, row, h in terms(batch.column("text")):
                row, h, _ = _counted(row, h)
                values, where = np.unique(h, return_inverse=True)
                pos = np.bincount(where, y[lo + row], len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(pos), pa.array(np.bincount(where, minlength=len(values)))], names=["term", "pos", "all"])

    total, p = float(n[0] + n[1]), float(n[1])
    df = narrow(rows.select("text", "y")).mapInArrow(count, "term long, pos long, all long").groupBy("term").agg(F.sum("pos").cast("double").alias("a"), F.sum("all").cast("double").alias("d"))
    off = F.col("a") * F.lit(total) - F.col("d") * F.lit(p)
    chi = off * off / (F.col("d") * (F.lit(total) - F.col("d") + 1) * F.lit(max(p * (total - p), 1.0)))
    clean = F.col("d") - F.col("a")
    df = df.where((F.col("d") >= LEAST_EXAMPLES) & (off > 0) & (clean <= STOP * (total - p)))
    ranked = df.select("term", F.log(F.lit(total + 1) / F.col("d")).alias("idf"), chi.alias("chi"))
    return ranked.orderBy(F.desc("chi"), "term").limit(most)


class Index:
    """The examples' vectors as postings by (term, block), with the largest weight of each."""

    def __init__(self, term: np.ndarray, idf: np.ndarray, doc: list[int], y: np.ndarray, weight: tuple[float, float]):
        by = np.argsort(term)
        self.term, self.idf = term[by], idf[by]
        order = sorted(range(len(doc)), key=lambda i: (doc[i], y[i]))
        self.doc, self.y = np.array([doc[i] for i in order], dtype=np.int64), np.array([y[i] for i in order], dtype=np.float64)
        self.order = order
        self.votes = np.where(self.y > 0, weight[1], weight[0])
        self.blocks = -(-len(doc) // BLOCK)
        self.blank, self.slope, self.shift, self.prior = 0.0, 1.0, 0.0, float((self.y * self.votes).sum() / max(self.votes.sum(), 1e-9))

    def fill(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Index:
        """Takes the example vectors, in the order that ``doc`` was given."""
        vectors = [vectors[i] for i in self.order]
        t = np.concatenate([v[0] for v in vectors] + [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        e = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
        w = np.concatenate([v[1] for v in vectors] + [np.zeros(0)])
        by = np.lexsort((e, t))
        self.example, self.weight = e[by], w[by]
        cell = t[by] * self.blocks + e[by] // BLOCK
        self.ptr = np.searchsorted(cell, np.arange(len(self.term) * self.blocks + 1))
        top = np.zeros(len(self.term) * self.blocks)
        np.maximum.at(top, cell, w[by])
        self.top = top.reshape(len(self.term), self.blocks)
        empty = np.array([len(v[0]) == 0 for v in vectors], dtype=bool)
        self.blank = float((self.y * self.votes)[empty].sum() / self.votes[empty].sum()) if empty.any() else self.prior
        self._calibrate([v for v, none in zip(vectors, empty) if not none], np.flatnonzero(~empty))
        return self

    def vector(self, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chosen terms of a text (numbers and weights), from its distinct term hashes and their counts."""
        at = np.searchsorted(self.term, values)
        at[at == len(self.term)] = 0
        hit = self.term[at] == values if len(self.term) else np.zeros(len(values), dtype=bool)
        at, w = at[hit], (1 + np.log(counts[hit])) * self.idf[at[hit]]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples (numbers in doc_id order) with the k largest cosines, all above zero, and the cosines."""
        bound = w @ self.top[at]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, cos = np.zeros(0, dtype=np.int64), np.zeros(0)
        step, lo = 4, 0
        while lo < len(order):
            worst = cos[-1] if len(cos) >= k else 0.0
            blocks = order[lo : lo + step]
            blocks = blocks[bound[blocks] >= worst - 1e-12]
            if not len(blocks):
                break
            cells = (at[:, None] * self.blocks + blocks[None, :]).ravel()
            first, n = self.ptr[cells], self.ptr[cells + 1] - self.ptr[cells]
            take = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found, where = np.unique(self.example[take], return_inverse=True)
            score = np.bincount(where, np.repeat(np.repeat(w, len(blocks)), n) * self.weight[take], len(found))
            keep = found != but
            ids, cos = np.concatenate([ids, found[keep]]), np.concatenate([cos, score[keep]])
            best = np.lexsort((ids, -np.round(cos, 12)))[:k]
            ids, cos = ids[best], cos[best]
            lo, step = lo + step, step * 2
        return ids, cos

    def vote(self, ids: np.ndarray, cos: np.ndarray) -> float:
        c = cos * cos * self.votes[ids] / max(self.votes.mean(), 1e-9)
        return float(((c * self.y[ids]).sum() + self.prior) / (c.sum() + 1))

    def score(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.slope * np.log(v / (1 - v)) + self.shift))))

    def _calibrate(self, vectors: list, which: np.ndarray) -> None:
        """Logistic curve from the votes of all others to the label, by Newton steps with a weak pull to the identity."""
        if not len(which):
            return
        v = np.clip([self.vote(*self.nearest(*x, but=int(i))) for x, i in zip(vectors, which)], 1e-6, 1 - 1e-6)
        x, y, n = np.log(v / (1 - v)), self.y[which], self.votes[which]
        for _ in range(25):
            p = 1 / (1 + np.exp(-(self.slope * x + self.shift)))
            g = np.array([(n * (p - y) * x).sum() + self.slope - 1, (n * (p - y)).sum() + self.shift])
            c = n * p * (1 - p)
            h = np.array([[(c * x * x).sum() + 1, (c * x).sum()], [(c * x).sum(), c.sum() + 1]])
            d = np.linalg.solve(h, g)
            self.slope, self.shift = self.slope - d[0], self.shift - d[1]
            if abs(d).max() < 1e-9:
                break


def learn(docs: DataFrame, labels: DataFrame, size: int = EXAMPLES, most: int = TERMS) -> Index:
    some = cut_lineage(examples(labels, size))
    n = {0: 0, 1: 0} | {r["y"]: r["count"] for r in some.groupBy("y").count().collect()}
    all_n = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in labels.where(fold("doc_id", 5) != 0).where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    rows = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    picked = chosen_terms(rows, n, most).toArrow()
    term = picked["term"].to_numpy().view(np.uint64)
    idf = picked["idf"].to_numpy()
    probe = Index(term, idf, [], np.zeros(0), (1.0, 1.0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, w = [], []
            for own in vectors_of(probe, batch.column("text")):
                at.append(own[0].astype(np.int32))
                w.append(own[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float64()))], names=["doc_id", "y", "at", "w"])

    got = narrow(rows.select("doc_id", "text", "y")).mapInArrow(vectors, "doc_id long, y int, at array<int>, w array<double>").toArrow()
    index = Index(term, idf, got["doc_id"].to_pylist(), got["y"].to_numpy(), tuple(all_n[y] / max(n[y], 1) for y in (0, 1)))
    return index.fill([(np.array(a, dtype=np.int64), np.array(w)) for a, w in zip(got["at"].to_pylist(), got["w"].to_pylist())])


def vectors_of(index: Index, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for lo, hi, row, h in terms(texts):
        at = np.searchsorted(index.term, h)
        at[at == len(index.term)] = 0
        hit = index.term[at] == h if len(index.term) else np.zeros(len(h), dtype=bool)
        row, value, count = _counted(row[hit], h[hit])
        firsts = np.searchsorted(row, np.arange(hi - lo + 1))
        for r in range(hi - lo):
            own = slice(firsts[r], firsts[r + 1])
            yield index.vector(value[own], count[own])


def _scored(index: Index, texts: pa.Array) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    for at, w in vectors_of(index, texts):
        if len(at):
            ids, cos = index.nearest(at, w)
            yield index.score(index.vote(ids, cos)), ids, cos
        else:
            yield index.blank, np.zeros(0, dtype=np.int64), np.zeros(0)


def report(docs: DataFrame, labels: DataFrame, size: int = EXAMPLES, most: int = TERMS) -> DataFrame:
    """One row per document: whether it was held out of learning, score, decision, and the nearest examples."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, size, most))
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            scores, evidence = [], []
            for score, ids, cos in _scored(index, batch.column("text")):
                scores.append(score)
                evidence.append([{"doc_id": int(index.doc[i]), "cosine": float(c), "label": int(index.y[i])} for i, c in zip(ids[:3], cos[:3])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    out = narrow(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def clean(docs: DataFrame, labels: DataFrame, size: int = EXAMPLES, most: int = TERMS) -> DataFrame:
    """The documents not taken for toxic, with the columns they came with."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, size, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [score < CUT for score, _, _ in _scored(held.value, batch.column("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return narrow(docs).mapInArrow(run, docs.schema)
