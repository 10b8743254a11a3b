"""Helpers the operators share: tables and batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def narrow(df: DataFrame) -> DataFrame:
    """Arrow batches of a few MB on average, whatever the session's default (a plain runtime setting)."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return df


# A table joined by broadcast holds at most so many rows and bytes; past either bound the same join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20


def small_side(df: DataFrame, arrays: tuple[str, ...] = ()) -> DataFrame:
    """The written table ``df``, marked for broadcast if its measured size is inside the bounds.

    ``arrays`` names the columns whose length varies (arrays of numbers). Either way the join gives the same rows.
    """
    width = F.lit(24).cast("long")
    for c in arrays:
        width = width + F.coalesce(F.size(c), F.lit(0)) * 8
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= BROADCAST_ROWS and row["b"] <= BROADCAST_BYTES else df


def row_slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, one row at least."""
    lo, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        n = n or 0
        if i > lo and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(texts) > lo:
        yield lo, len(texts)


__all__ = ["cut_lineage", "narrow", "row_slices", "small_side", "table"]
