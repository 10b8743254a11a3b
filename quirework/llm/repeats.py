"""Substring dedup by level-wise doubling.

A window of ``WINDOW`` words can only repeat if the shorter windows in it repeat. Level k starts at ``START`` words:
of every candidate window the k-word run with the least hash stands for it (equal windows choose equal runs); runs
that occur once in the whole table drop out with their windows, the rest go on to the next level at twice the
length. At the last level the run is the window itself, by a 128-bit hash, and every occurrence but the first in
(doc_id, start) order is removed. Longer repeats need no further level: all their windows are found at this one.

Exact copies of a text are set aside first: only the copy with the least doc_id has windows to compare. What a task
already knows to be repeated inside its own slice of texts is not shuffled; per slice one row for a run goes out, so
a passage that a third of all texts share is a row per slice and not a row per text.

Null and empty texts have no words. A text of fewer than ``WINDOW`` words loses nothing. Rows with the same doc_id
are one document when it comes to what starts earlier, and each row gets its own result; a null doc_id sorts last.
Columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import cut_lineage, narrow

WINDOW = 20
START = 5
LAST_ID = 2**63 - 1

_MOST = np.uint64(2**64 - 1)


def levels(window: int, start: int) -> list[int]:
    """Window lengths from ``start`` on, each at most twice the one before, up to the whole window."""
    out = [min(start, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _least(w: words.Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes, and by first word the least one of each window (0 where the window leaves its row)."""
    g = words.grams(w.hashes, k)
    least = words.run_minimum(g, window - k + 1) if len(g) >= window - k + 1 else g[:0]
    return g, np.where(words.inside_rows(w.counts, window, len(least)), least, 0)


def _candidates(w: words.Words, at: list, k: int, window: int) -> np.ndarray:
    """Windows whose least k-gram is among the runs that the level before kept, given by row as word numbers."""
    g, least = _least(w, k, window)
    kept = np.full(len(g), _MOST, dtype=np.uint64)
    firsts = w.firsts
    for r, own in enumerate(at):
        if own is not None and len(own):
            own = own[own < w.counts[r]] + firsts[r]
            own = own[own < len(g)]
            kept[own] = g[own]
    if not len(least):
        return np.zeros(0, dtype=bool)
    return (least > 0) & (words.run_minimum(kept, window - k + 1) == least)


def _chosen(w: words.Words, candidate: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (over the slice) and hashes of the k-word runs that stand for the candidate windows."""
    g, least = _least(w, k, window)
    least = np.where(candidate, least, 0)
    span = window - k + 1
    pad = np.zeros(span - 1, dtype=np.uint64)
    most = ~words.run_minimum(~np.concatenate([pad, least, pad]), span)[: len(g)]
    at = np.flatnonzero((most == g) & (most > 0)) if len(least) else np.zeros(0, dtype=np.int64)
    return at, g[at]


def _level(docs: DataFrame, k: int, before: int | None, window: int, known: bool) -> DataFrame:
    """Rows of a level: runs to compare across tasks, or (``known``) runs already seen twice in one slice."""
    last = k == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy()
            vers = batch.column("ver").to_numpy()
            held = batch.column("at") if before else None
            for w in words.word_slices(batch.column("text"), words.NOT_SPACE, words.SAME, second=last):
                if len(w.hashes) < window:
                    continue
                if before:
                    at = [held[i].values.to_numpy() if held[i].is_valid else None for i in range(w.lo, w.hi)]
                    candidate = _candidates(w, at, before, window)
                else:
                    candidate = words.inside_rows(w.counts, window, len(w.hashes) - window + 1)
                if not candidate.any():
                    continue
                pos, a = _chosen(w, candidate, k, window)
                b = words.grams(w.second, k, 1)[pos] if last else np.zeros(len(pos), dtype=np.uint64)
                row = w.rows[pos]
                doc, ver, own = ids[w.lo + row], vers[w.lo + row], pos - w.firsts[row]
                by = np.lexsort((own, doc, b, a))
                a, b, row, doc, ver, own = a[by], b[by], row[by], doc[by], ver[by], own[by]
                new = np.ones(len(a), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                heads = np.flatnonzero(new)
                size = np.diff(np.append(heads, len(a)))
                if known:
                    if last:  # later than the first of its slice
                        head = np.repeat(heads, size)
                        seen = (doc != doc[head]) | (own != own[head])
                    else:
                        seen = np.repeat(size, size) > 1
                    yield _by_row(doc[seen], ver[seen], row[seen], own[seen])
                else:
                    cols = [pa.array(x[heads].view(np.int64)) for x in (a, b)] + [pa.array(doc[heads]), pa.array(ver[heads]), pa.array(own[heads].astype(np.int32)), pa.array(size > 1)]
                    names = ["a", "b", "doc", "ver", "pos", "many"]
                    drop = {"many"} if last else {"b", "ver"}
                    yield pa.RecordBatch.from_arrays([c for c, n in zip(cols, names) if n not in drop], names=[n for n in names if n not in drop])

    kind = "doc long, ver long, at array<int>" if known else "a long, b long, doc long, ver long, pos int" if last else "a long, doc long, pos int, many boolean"
    return docs.mapInArrow(run, kind)


def _by_row(doc: np.ndarray, ver: np.ndarray, row: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    by = np.lexsort((own, row))
    doc, ver, row, own = doc[by], ver[by], row[by], own[by]
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)).astype(np.int32)), pa.array(own.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(doc[heads]), pa.array(ver[heads]), lists], names=["doc", "ver", "at"])


def _kept(docs: DataFrame, k: int, before: int | None, window: int) -> DataFrame:
    """By document, the word numbers of the level's runs that occur elsewhere too (last level: earlier)."""
    if k == window:
        keys = ["doc", "ver"]
        first = F.min(F.struct("doc", "pos")).over(Window.partitionBy("a", "b"))
        found = _level(docs, k, before, window, False).withColumn("first", first).where(F.struct("doc", "pos") > F.col("first"))
    else:
        keys = ["doc"]
        here = Window.partitionBy("a")
        found = _level(docs, k, before, window, False).withColumn("n", F.count("*").over(here) + F.max(F.col("many").cast("int")).over(here)).where("n > 1")
    rows = found.select(*keys, F.array("pos").alias("at")).unionByName(_level(docs, k, before, window, True).select(*keys, "at"))
    return cut_lineage(rows.groupBy(*keys).agg(F.flatten(F.collect_list("at")).alias("at")))


def removed_windows(docs: DataFrame, window: int = WINDOW, start: int = START) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents keyed by doc and text hash, copies of an earlier text, starts of windows to remove)."""
    keyed = narrow(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("ver"))
    sums = keyed.where("text is not null").select("doc", "ver", F.xxhash64(F.lit(7), "text").alias("also"))
    first = sums.groupBy("ver", "also").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = cut_lineage(sums.join(first, ["ver", "also"]).where("doc > first").select("doc", "ver").distinct())
    lone = keyed.join(copies, ["doc", "ver"], "left_anti").select("doc", "ver", "text")
    at, before = None, None
    for k in levels(window, start):
        source = lone if at is None else lone.join(at, "doc")
        at, before = _kept(source, k, before, window), k
    return keyed, copies, at


def report(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """One row per document: words, words removed, and the digest of the words that stay (``kept`` has them)."""
    return clean(docs, window, start).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def clean(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed, and the kept words joined by one space."""
    keyed, copies, at = removed_windows(docs, window, start)
    marked = keyed.join(copies.withColumn("copy", F.lit(True)), ["doc", "ver"], "left").join(at, ["doc", "ver"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy, held = pc.fill_null(batch.column("copy"), False).to_pylist(), batch.column("at")
            n, gone, kept = [], [], []
            for w in words.word_slices(batch.column("text"), words.NOT_SPACE, words.SAME):
                firsts = w.firsts
                for i in range(w.lo, w.hi):
                    lo, hi = firsts[i - w.lo], firsts[i - w.lo + 1]
                    total = int(hi - lo)
                    out = np.zeros(total, dtype=bool)
                    if copy[i] and total >= window:
                        out[:] = True
                    elif held[i].is_valid:
                        edge = np.zeros(total + 1, dtype=np.int64)
                        s = held[i].values.to_numpy()
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + window, -1)
                        out = np.cumsum(edge[:-1]) > 0
                    n.append(total)
                    gone.append(int(out.sum()))
                    kept.append(_joined(w, lo, hi, ~out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return marked.select("doc_id", "text", "copy", "at").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _joined(w: words.Words, lo: int, hi: int, keep: np.ndarray) -> str:
    s, e = w.starts[lo:hi][keep], w.ends[lo:hi][keep]
    if not len(s):
        return ""
    width = e - s + 1
    to = np.cumsum(width) - width
    out = np.full(int(width.sum()), 32, dtype=np.uint8)
    step = np.arange(int((e - s).sum())) - np.repeat(np.cumsum(e - s) - (e - s), e - s)
    out[np.repeat(to, e - s) + step] = w.data[np.repeat(s, e - s) + step]
    return out[:-1].tobytes().decode()
