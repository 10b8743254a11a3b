"""Sinks: run outputs, texts, snapshots and reports, each read back before anything is claimed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def write_run_output(results: DataFrame, path: str) -> None:
    """Finished files of every run; nothing else is written.

    Rows are laid out by ranges of (run, ordinal): a large run is cut over many writers, many small runs
    share one file, and a reader of one run skips the rest by file statistics. A folder per run would
    leave a file per run and task.
    """
    done = results.where("kind = 'done'")
    done.repartitionByRange("run_id", "ordinal").sortWithinPartitions("run_id", "ordinal").write.mode("errorifexists").parquet(path)


def read_manifest(results: DataFrame, path: str) -> DataFrame:
    """What the sink holds, read from the files and not from memory."""
    return results.sparkSession.read.parquet(path)


def write_texts(texts: DataFrame, path: str) -> None:
    texts.select("doc_id", "text").write.mode("errorifexists").parquet(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Sorted by key over ranges, so the files together are in key order."""
    snapshot.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)
