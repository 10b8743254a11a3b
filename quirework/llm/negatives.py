"""Hard negatives by bounds along a spanning tree of the anchors.

The anchors are sorted by label and a projection and cut into blocks of at most ``BLOCK``; each block has a minimum
spanning tree whose root is the zero vector, which scores 0 with everything. Along an edge from parent p to child c the
score with a candidate v changes by (c - p).v, so it lies within |c - p||v| of the parent's: from the parent's exact
score where it was worked out, else from the parent's own bounds, which only get wider. A child works out the scores of
those candidates alone whose bounds reach what it looks for:

1. positives, the first ``positives`` rows of the anchor's label: whoever can still reach the k-th best lower bound;
2. negatives, rows of another label whose score lies in the window of a positive, low/100 to high/100 of its score:
   whoever can lie in a window.

Candidates are packed into chunks of at most ``CHUNK`` rows, which every block of anchors visits: chunks are dealt to
parts, and each part gets every block. A visit hands on only the first few of each anchor (and positive); Spark limits
those again per task before they are shuffled by anchor. No group is gathered anywhere, a common label or vector is
spread over all chunks, and the blocks are broadcast only where Spark finds the written table small.

Scores are exact integers: in double precision while they surely fit 53 bits, else in 64 bits or Python's integers
without bounds. Rows with a null vec_id, label or vector or with null or non-finite entries take no part, in any role;
rows equal in vec_id, label and vector are one row, and rows that only share a vec_id are rows of their own (an anchor's
positives may have its vec_id, never itself). Vectors of different lengths have no score, so neither is a candidate of
the other. Ties go to the smaller vec_id; a window of a negative score is empty, that of 0 holds 0. Scaled entries stop at
2**56 and scores are given as long, cut at its ends. Anchors without a positive or a negative give no row; an empty
table gives none. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, narrow

BLOCK = 1024
CHUNK = 4096
CHUNKS_PER_PART = 16
MOST = 2.0**56
EXACT = 2.0**52  # scores below this are exact in double precision, and so are their bounds but for a relative 1e-9


def sound(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and x (integers), each row once."""
    c = F.col("embedding")
    whole = c.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(
        c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-MOST)), F.lit(MOST))))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest of three widths that holds the matrix, and its bytes."""
    most = int(np.abs(x).max(initial=0))
    width = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<i8"
    return width, x.astype(width).tobytes()


def _bounded(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_id, label, matrix) of at most ``most`` rows of one vector length, from batches of any size."""
    held: dict[int, list] = {}
    for batch in batches:
        sizes = np.diff(batch.column("x").offsets.to_numpy()) if len(batch) else np.zeros(0, int)
        for d in np.unique(sizes).tolist():
            own = batch.take(pa.array(np.flatnonzero(sizes == d)))
            rows = held.setdefault(d, [])
            rows.append((own.column("vec_id").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("x")) if d else np.zeros((len(own), 0), np.int64)))
            while sum(len(r[0]) for r in rows) >= most:
                ids, labels, x = (np.concatenate(c) for c in zip(*rows))
                yield ids[:most], labels[:most], x[:most]
                rows[:] = [(ids[most:], labels[most:], x[most:])] if len(ids) > most else []
    for rows in held.values():
        if rows:
            yield tuple(np.concatenate(c) for c in zip(*rows))


def tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows and the zero vector, its root: the rows in an order in which a parent comes
    right before its first child's subtree, their depths (1 below the root), and their distances to their parents."""
    y = x.astype(np.float64)
    near, parent = np.sqrt((y * y).sum(axis=1)), np.full(len(y), -1)
    edge, children, left = near.copy(), [[] for _ in range(len(y) + 1)], np.ones(len(y), bool)
    for _ in range(len(y)):
        at = int(np.argmin(np.where(left, near, np.inf)))
        left[at], edge[at] = False, near[at]
        children[parent[at]].append(at)
        gap = y - y[at]
        to = np.sqrt((gap * gap).sum(axis=1))
        closer = left & (to < near)
        near[closer], parent[closer] = to[closer], at
    order, depth, stack = [], [], [(c, 1) for c in reversed(children[-1])]
    while stack:
        at, deep = stack.pop()
        order.append(at)
        depth.append(deep)
        stack += [(c, deep + 1) for c in reversed(children[at])]
    return np.array(order, dtype=np.int64), np.array(depth, dtype=np.int32), edge[order]


ROWS = "d int, n int, ids binary, labels binary, width string, x binary"
BLOCKS = "block long, " + ROWS + ", depths binary, edges binary"


def _row(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> list[pa.Array]:
    width, data = _packed(x)
    return [pa.array([x.shape[1]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([labels.astype("<i8").tobytes()]), pa.array([width]), pa.array([data])]


def chunks(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x in _bounded(batches, CHUNK):
            yield pa.RecordBatch.from_arrays(_row(ids, labels, x), names=["d", "n", "ids", "labels", "width", "x"])

    return cut_lineage(narrow(rows).mapInArrow(run, ROWS))


def blocks(anchors: DataFrame) -> DataFrame:
    """The anchors in blocks of neighbours, each with its tree; a block is made inside one sorted partition."""
    sign = lambda i: F.when(F.pmod(F.hash(i), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    side = F.aggregate(F.transform("x", lambda v, i: v.cast("double") * sign(i)), F.lit(0.0), lambda a, b: a + b)
    anchors = cut_lineage(anchors.withColumn("side", side))
    count = anchors.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, (ids, labels, x) in enumerate(_bounded(batches, BLOCK)):
            order, depths, edges = tree(x)
            arrays = [pa.array([first + k], pa.int64()), *_row(ids[order], labels[order], x[order]), pa.array([depths.astype("<i4").tobytes()]), pa.array([edges.astype("<f8").tobytes()])]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "d", "n", "ids", "labels", "width", "x", "depths", "edges"])

    dealt = anchors.repartitionByRange(-(-count // BLOCK) or 1, "label", "side", "vec_id").sortWithinPartitions("label", "side", "vec_id")
    return cut_lineage(narrow(dealt.select("vec_id", "label", "x")).mapInArrow(run, BLOCKS))


class Rows:
    """Candidates or anchors of one packed row."""

    def __init__(self, d: int, n: int, ids: bytes, labels: bytes, width: str, x: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.x = np.frombuffer(x, width).reshape(n, d)
        self.most = int(np.abs(self.x.astype(np.int64)).max(initial=0))


def visit(own: Rows, anchors: Rows, depths: np.ndarray, edges: np.ndarray, wanted: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, candidates, their exact scores) along the tree; ``wanted(anchor, low, high)`` says from bounds which
    candidates an anchor needs (positions), or None for none."""
    d = own.x.shape[1]
    if own.most * anchors.most * max(d, 1) >= EXACT:
        kind = np.int64 if own.most * anchors.most * d < 2**62 else object
        x = own.x.astype(kind)
        for i in range(len(anchors.ids)):
            score = x @ anchors.x[i].astype(kind) if d else np.zeros(len(x), kind)
            at = wanted(i, score, score)
            if at is not None and len(at):
                yield i, at, score[at]
        return
    x, y = own.x.astype(np.float64), anchors.x.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9)
    path = [(np.zeros(len(x)), np.zeros(len(x)))]
    for i, (deep, edge) in enumerate(zip(depths.tolist(), edges.tolist())):
        del path[deep:]
        middle, radius = path[-1]
        radius = radius + edge * norms
        at = wanted(i, middle - radius - 0.5, middle + radius + 0.5)
        if at is not None and len(at):
            if 2 * len(at) > len(x):
                middle, radius = x @ y[i], np.zeros(len(x))
            else:
                middle = middle.copy()
                middle[at], radius[at] = x[at] @ y[i], 0.0
            yield i, at, middle[at]
        path.append((middle, radius))


def _first(k: int, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda j: (-score[j], ids[j]))[:k], dtype=np.int64)
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return at[np.lexsort((ids[at], -score[at]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _long(v) -> int:
    return max(-(2**63), min(2**63 - 1, int(v)))


def best_of_label(own: Rows, anchors: Rows, depths: np.ndarray, edges: np.ndarray, k: int) -> list[tuple[int, int, str]]:
    """(anchor, vec_id, score) of the first k rows of each anchor's label, without itself."""
    by_label: dict[int, np.ndarray] = {}

    def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        label = int(anchors.labels[i])
        if label not in by_label:
            by_label[label] = np.flatnonzero(own.labels == label)
        at = by_label[label]
        same = at[own.ids[at] == anchors.ids[i]]
        itself = [j for j in same.tolist() if (own.x[j] == anchors.x[i]).all()]
        if itself:
            at = at[~np.isin(at, itself)]
        if len(at) > k:
            at = at[high[at] >= np.partition(low[at], -k)[-k]]
        return at

    out = []
    for i, at, score in visit(own, anchors, depths, edges, wanted):
        out += [(i, int(own.ids[at[j]]), str(int(score[j]))) for j in _first(k, score, own.ids[at]).tolist()]
    return out


def in_windows(own: Rows, anchors: Rows, depths: np.ndarray, edges: np.ndarray, windows: dict[int, list[tuple[int, int, int]]], k: int) -> list[tuple[int, int, int, str]]:
    """(anchor, positive's number, vec_id, score) of the first k rows of another label in each (number, low, high)."""
    other: dict[int, np.ndarray] = {}

    def wanted(i: int, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
        if i not in windows:
            return None
        label = int(anchors.labels[i])
        if label not in other:
            other[label] = np.flatnonzero(own.labels != label)
        at = other[label]
        lows, highs = low[at], high[at]
        hit = np.zeros(len(at), bool)
        for _, a, b in windows[i]:
            hit |= (highs >= a) & (lows <= b)
        return at[hit]

    out = []
    for i, at, score in visit(own, anchors, depths, edges, wanted):
        for r, a, b in windows[i]:
            inside = np.flatnonzero((score >= a) & (score <= b))
            if len(inside):
                out += [(i, r, int(own.ids[at[j]]), str(int(score[j]))) for j in inside[_first(k, score[inside], own.ids[at[inside]])].tolist()]
    return out


def _visits(chunk_table: DataFrame, block_table: DataFrame, kind: str, work: Callable[[dict, Rows, Rows, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """``work`` on every pair of a chunk and a block of the same vector length."""
    spark = chunk_table.sparkSession
    count = chunk_table.count()
    parts = max(1, min(count, max(spark.sparkContext.defaultParallelism * 2, -(-count // CHUNKS_PER_PART))))
    dealt = chunk_table.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).repartition(parts, "part")
    every = block_table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    names = ["n", "ids", "labels", "width", "x"]
    every = every.select(*[F.col(c).alias(f"block_{c}") if c in names else F.col(c) for c in every.columns])
    fields = [f.split()[0] for f in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                own = Rows(r["d"], *[r[c] for c in names])
                anchors = Rows(r["d"], *[r[f"block_{c}"] for c in names])
                got = work(r, own, anchors, np.frombuffer(r["depths"], "<i4"), np.frombuffer(r["edges"], "<f8"))
                if got:
                    columns = list(zip(*got))
                    arrays = [pa.array([r["block"]] * len(got), pa.int64())] + [pa.array(c) if isinstance(c[0], str) else pa.array(c, pa.int64()) for c in columns]
                    yield pa.RecordBatch.from_arrays(arrays, names=fields)

    conf = spark.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row holds a chunk and a block
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return dealt.join(every, ["part", "d"]).mapInArrow(run, kind)


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key by score; Spark keeps k per key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("score", F.col("score").cast("decimal(38,0)")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: str, scale: int = 256, low: int = 80, high: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchors`` picks rows of ``vectors``."""
    chunk_table = chunks(sound(vectors, scale))
    block_table = blocks(sound(vectors.where(anchors), scale))

    def near(r: dict, own: Rows, held: Rows, depths: np.ndarray, edges: np.ndarray) -> list[tuple]:
        return best_of_label(own, held, depths, edges, positives)

    found = _top(_visits(chunk_table, block_table, "block long, a long, vec_id long, score string", near), ["block", "a"], positives)
    window = F.struct("a", "rank", "vec_id", F.col("score").cast("string").alias("score"))
    windows = found.groupBy("block").agg(F.collect_list(window).alias("windows"))  # at most BLOCK * positives
    block_table = cut_lineage(block_table.join(windows, "block"))

    def hard(r: dict, own: Rows, held: Rows, depths: np.ndarray, edges: np.ndarray) -> list[tuple]:
        spans, about = {}, {}
        for w in r["windows"]:
            p = int(w["score"])
            a, b = -(-low * p // 100), high * p // 100
            about[w["a"], w["rank"]] = int(held.ids[w["a"]]), w["vec_id"], _long(p)
            if a <= b:
                spans.setdefault(w["a"], []).append((w["rank"], a, b))
        return [(*x, *about[x[0], x[1]]) for x in in_windows(own, held, depths, edges, spans, negatives)]

    got = _visits(chunk_table, block_table, "block long, a long, r long, vec_id long, score string, anchor_id long, positive_id long, positive_score long", hard)
    ends = F.least(F.greatest("score", F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)"))
    return _top(got, ["block", "a", "r"], negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", ends.cast("long").alias("negative_score"))


def shifted_labels(vectors: DataFrame, label: Column | str = "label") -> DataFrame:
    """Labels moved on by one, modulo ten, in rows whose vec_id is divisible by seven."""
    label = F.col(label).cast("long") if isinstance(label, str) else label
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
