"""Benchmark decontamination by winnowing.

The least 5-gram hash of every 13-word window of a text is its fingerprint, so any shared span of 13 words shares
one. A window whose fingerprint occurs among a benchmark item's 5-grams is a hit to extend: its full window hash
(two independent 64-bit halves) is looked up among the item windows, and every word inside a found window counts.
Items shorter than a window are one window of their own length, looked up by the hash of that length.

The benchmark is cut into blocks of at most ``BLOCK`` windows; a block is broadcast (its size is bounded by that
parameter) and the documents pass over the blocks one after the other without a shuffle. Documents never leave
their partition, so no source, copy group or common passage makes a task larger.

Null and empty texts have no words, hit nothing and are not contaminated. Null benchmark texts have no window;
windows of items without an id count as hits and are named by nobody. Repeated documents each get their row,
repeated items count once. Columns beside doc_id and text are neither needed nor looked at by ``report`` and pass
unchanged through ``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import cut_lineage, narrow

WINDOW = 13
K = 5
BLOCK = 500_000

REPORT = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def item_windows(bench: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per window of each item: its length, both hash halves, and its k-gram hashes (of a full window only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").cast(pa.string())
            for w in words.word_slices(batch.column("text"), words.ALNUM, second=True):
                firsts = w.firsts
                out = {"item_id": [], "n": [], "a": [], "b": [], "grams": []}
                for r in range(w.hi - w.lo):
                    h, h2 = w.hashes[firsts[r] : firsts[r + 1]], w.second[firsts[r] : firsts[r + 1]]
                    n = min(window, len(h))
                    if not n:
                        continue
                    a, b, g = words.grams(h, n), words.grams(h2, n, 1), words.grams(h, k)
                    for p in range(len(a)):
                        out["item_id"].append(ids[w.lo + r].as_py())
                        out["n"].append(n)
                        out["a"].append(int(a[p].astype(np.int64)))
                        out["b"].append(int(b[p].astype(np.int64)))
                        out["grams"].append(words.signed(g[p : p + n - k + 1]).tolist() if n == window else [])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("grams", pa.list_(pa.int64()))])
    rows = narrow(bench.select("item_id", "text")).mapInArrow(run, "item_id string, n int, a long, b long, grams array<long>")
    return rows.dropDuplicates(["item_id", "n", "a", "b"])


class Index:
    """One block of item windows: sorted arrays."""

    def __init__(self, rows: pa.Table):
        a = rows["a"].to_numpy().view(np.uint64)
        by = np.argsort(a, kind="stable")
        self.a, self.b, self.n = a[by], rows["b"].to_numpy().view(np.uint64)[by], rows["n"].to_numpy()[by]
        self.ids = [rows["item_id"][int(i)].as_py() for i in by]
        grams = rows["grams"].combine_chunks()
        self.grams = np.unique((grams.flatten() if len(rows) else pa.array([], pa.int64())).to_numpy().view(np.uint64))
        self.lengths = np.unique(self.n).tolist()


def _known(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def find(w: words.Words, index: Index, window: int, k: int) -> tuple[np.ndarray, dict[int, set]]:
    """Which words of the slice are hit, and the items found by row."""
    total = len(w.hashes)
    edge = np.zeros(total + 1, dtype=np.int64)
    items: dict[int, set] = {}
    rows = w.rows
    for n in index.lengths:
        if n > total:
            continue
        if n == window:
            least = words.run_minimum(words.grams(w.hashes, k), window - k + 1)
            at = np.flatnonzero(words.inside_rows(w.counts, n, len(least)) & _known(least, index.grams))
        else:
            at = np.flatnonzero(words.inside_rows(w.counts, n, total - n + 1))
        if not len(at):
            continue
        a = _gram_at(w.hashes, at, n, 0)
        here = _known(a, index.a)
        at, a = at[here], a[here]
        if not len(at):
            continue
        b = _gram_at(w.second, at, n, 1)
        lo, hi = np.searchsorted(index.a, a), np.searchsorted(index.a, a, side="right")
        for p, y, s, e in zip(at, b, lo, hi):
            same = [i for i in range(s, e) if index.b[i] == y and index.n[i] == n]
            if same:
                edge[p] += 1
                edge[p + n] -= 1
                items.setdefault(int(rows[p]), set()).update(index.ids[i] for i in same if index.ids[i] is not None)
    return np.cumsum(edge[:-1]) > 0, items


def _gram_at(h: np.ndarray, at: np.ndarray, n: int, which: int) -> np.ndarray:
    """The n-gram hash at the given words only, the same value as ``words.grams`` gives there."""
    if len(at) * 4 > len(h):
        return words.grams(h, n, which)[at]
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(n):
        out = out * words._GRAM[which] + h[at + j]
    return words.mix(out, n * 2 + which)


def indexes(bench: DataFrame, window: int = WINDOW, k: int = K, block: int = BLOCK) -> list:
    """Broadcast blocks of the benchmark, each of about ``block`` windows at most."""
    rows = cut_lineage(item_windows(bench, window, k))
    sc = bench.sparkSession.sparkContext
    n = -(-rows.count() // block)
    part = F.pmod(F.xxhash64("a", "b"), F.lit(max(n, 1)))
    return [sc.broadcast(Index(rows.where(part == i).toArrow())) for i in range(n)]


def _scan(texts: pa.Array, held: list, window: int, k: int):
    """(words, words hit, sorted item ids) of every text."""
    for w in words.word_slices(texts, words.ALNUM, second=True):
        hit, items = np.zeros(len(w.hashes), dtype=bool), {}
        for index in held:
            one, found = find(w, index.value, window, k)
            hit |= one
            for r, ids in found.items():
                items.setdefault(r, set()).update(ids)
        firsts = w.firsts
        sums = np.concatenate([[0], np.cumsum(hit)])
        for r in range(w.hi - w.lo):
            yield int(w.counts[r]), int(sums[firsts[r + 1]] - sums[firsts[r]]), sorted(items.get(r, ()))


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def report(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = K, block: int = BLOCK) -> DataFrame:
    """One row per document: words, words hit, and the items they come from."""
    held = indexes(bench, window, k, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(_scan(batch.column("text"), held, window, k))
            out = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([x[0] for x in got], pa.int64()),
                pa.array([x[1] for x in got], pa.int64()),
                pa.array([len(x[2]) for x in got], pa.int64()),
                pa.array([hashlib.sha256(",".join(x[2]).encode()).hexdigest() for x in got], pa.string()),
                pa.array([contaminated(x[0], x[1]) for x in got], pa.bool_()),
                pa.array([x[2] for x in got], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    return narrow(docs.select("doc_id", "text")).mapInArrow(run, REPORT)


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, k: int = K, block: int = BLOCK) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    held = indexes(bench, window, k, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not contaminated(n, hit) for n, hit, _ in _scan(batch.column("text"), held, window, k)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return narrow(docs).mapInArrow(run, docs.schema)
