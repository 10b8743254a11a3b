"""Whitening of embeddings by a covariance over distinct vectors.

Entries become integers, so equal vectors can be grouped exactly: each distinct vector has the number of its rows as its
multiplicity. The fit takes that number (``weights="counts"``: the covariance of all rows) or one (``weights="one"``:
of the distinct vectors) as a vector's weight. Sums are integers; what is multiplied is n*x - S, exact before it is
divided by n once, so the centring costs no digits however far the data lie from zero. A task multiplies its vectors to
one d x d matrix, the matrices are added by Spark entry by entry, and d*d numbers (d is a vector's length) come back for
the eigenvectors. Every distinct vector is whitened once, and rows get the result by the 128-bit hash of their vector.

Vectors that more than one row in ``HEAVY`` has are fewer than ``HEAVY``: they are joined by broadcast, all others by
shuffle, so no key has more than a ``HEAVY``-th of the rows.

Rows with a null vector, null or non-finite entries, an empty vector or another length than most vectors (of equally
common lengths: the longest) take no part; rows without vec_id, repeated rows and equal vectors each come back. Without
rows the result is empty. Where the vectors span fewer dimensions than components are asked for, the rest have variance
zero: ``whitened`` is 0 and ``explained`` 0 there, and they are left out of ``identity_error``. Scaled entries
stop at 2**62 either way; a ``deviation`` that does not fit a long is null. Further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, narrow

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
HEAVY = 1000
MOST = 2.0**62
FLAT = 1e-13  # an eigenvalue below so much of the largest one (times d) is rounding

COLUMNS = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def sound(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x and its two hashes (a, b), for the rows that take part."""
    c = F.col("embedding")
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(whole).select("vec_id", F.transform(c, lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-MOST)), F.lit(MOST))) + F.lit(shift).cast("long")).alias("x"))
    return rows.withColumns({"a": F.xxhash64("x"), "b": F.xxhash64(F.lit(13), "x")})


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exactly: 64-bit integers while they surely fit, else Python's."""
    bound = n * int(max(x.max(initial=0), -int(x.min(initial=0)))) + max(abs(s) for s in sums)
    if bound < 2**62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def squares(y: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exactly; None past the range of long."""
    most = int(np.abs(y).max(initial=0))
    if y.dtype != object and most * most * y.shape[1] < 2**63:
        return (y * y).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (y.astype(object) ** 2).sum(axis=1)]


def _sums(distinct: DataFrame, weight: str) -> tuple[int, list[int]]:
    """The number of vectors fitted and their sums by dimension, as exact integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, w = _matrix(batch.column("x")), batch.column(weight).to_numpy()
                if int(w.sum()) * max(int(x.max()), -int(x.min()), 1) >= 2**62:
                    x, w = x.astype(object), w.astype(object)
                totals = [w.sum(), *(w @ x)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array([str(v) for v in totals])], names=["i", "v"])

    got = narrow(distinct.select("x", weight)).mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    held = {r["i"]: int(r["v"]) for r in got}
    return held[0], [held[i] for i in range(1, len(held))]


def _covariance(rows: DataFrame, column: str, weight: str, n: int, d: int, centre: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weighted covariance of ``centre(vectors)``, divisor n: one matrix product per batch, entries added by Spark."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                y = centre(_matrix(batch.column(column)))
                total += (y * batch.column(weight).to_numpy().astype(np.float64)[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], names=["i", "v"])

    got = narrow(rows.select(column, weight)).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    at = got.column("i").to_numpy()
    out[upper[0][at], upper[1][at]] = got.column("v").to_numpy() / n
    return np.where(np.tri(d, k=-1, dtype=bool), out.T, out)


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (zero where they are only rounding), unit eigenvectors as columns, shares of the trace; largest first."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    e = np.where(e > FLAT * len(e) * max(e[0], 0), e, 0.0)
    trace = float(np.trace(v))
    return e[:k], u[:, :k], e[:k] / trace if trace > 0 else np.zeros(len(e[:k]))


def _identity_error(white: DataFrame, weight: str, n: int, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on the written table."""
    if not k:
        return 0.0
    means = np.array([v / n for v in white.agg(*[F.sum(F.col(weight).cast("double") * F.col("z")[i]) for i in range(k)]).first()])
    return float(np.abs(_covariance(white, "z", weight, n, k, lambda z: z[:, :k] - means) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, weights: str = "counts") -> DataFrame:
    """One row per row of ``vectors`` and component: the columns of ``COLUMNS``."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be counts or one")
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["vec_id"]
    rows = sound(vectors, scale, shift)
    # Equal vectors meet after they were counted task by task: a hot vector is one row per task.
    grouped = cut_lineage(rows.groupBy("x", "a", "b").agg(F.count("*").alias("copies")).withColumn("one", F.lit(1).cast("long")))
    lengths = grouped.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], COLUMNS.format(kind))
    d, distinct = lengths["d"], grouped.where(F.size("x") == lengths["d"])
    weight = "copies" if weights == "counts" else "one"
    n, sums = _sums(distinct, weight)
    e, u, share = components(_covariance(distinct, "x", weight, n, d, lambda x: centred(x, n, sums).astype(np.float64) / n), k)
    k = len(e)
    scaled = np.where(e > 0, u / np.sqrt(np.where(e > 0, e, 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                y = centred(_matrix(batch.column("x")), n, sums)
                z = (y.astype(np.float64) / n) @ scaled
                z = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, dtype=np.int32)), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("copies"), batch.column("one"), pa.array(squares(y), pa.int64()), z], names=["a", "b", "copies", "one", "deviation", "z"])

    white = cut_lineage(narrow(distinct).mapInArrow(run, "a long, b long, copies long, one long, deviation long, z array<double>"))
    error = _identity_error(white, weight, n, int((e > 0).sum()))
    all_rows = n if weights == "counts" else lengths["c"]
    keyed = cut_lineage(rows.where(F.size("x") == d).select("vec_id", "a", "b"))  # read twice below, and slim
    result = white.select("a", "b", "deviation", "z")
    heavy = result.where(F.col("copies") * HEAVY > all_rows)  # fewer than HEAVY vectors
    hot = keyed.join(F.broadcast(heavy), ["a", "b"])
    cold = keyed.join(F.broadcast(heavy.select("a", "b")), ["a", "b"], "left_anti").join(result.where(F.col("copies") * HEAVY <= all_rows), ["a", "b"])
    shares = F.array(*[F.lit(float(s)) for s in share])
    return hot.unionByName(cold).select("vec_id", "deviation", F.posexplode("z").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(float(error)).alias("identity_error"))
