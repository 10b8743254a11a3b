"""The operators as named queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html, langid, lines, near, nearest, negatives, prefixes, quality, repeats, sql, toxicity, whiten
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.report(table(spark, folder, "documents"))


@query
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near.report(table(spark, folder, "documents"), size=4)


@query
def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


@query
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.report(table(spark, folder, "documents"))


@query
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.report(table(spark, folder, "documents"))


@query
def op8_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.report(table(spark, folder, "documents"))


@query
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


@query
def op11_byte_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.report(table(spark, folder, "documents"))


@query
def op12_hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(negatives.shifted_labels(table(spark, folder, "embeddings")), "vec_id % 100 = 0")


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whiten(table(spark, folder, "embeddings"))


# Learnt scores, approximate neighbours, page parsing, tokenisation and fuzzy lines have no SQL; tests/llm holds them
# against brute force, exact round trips or held-out rows.
ORACLES.update(op2_minhash_near_dedup=sql.NEAR, op6_substring_dedup=sql.REPEATS, op10_benchmark_decontamination=sql.CONTAMINATION, op12_hard_negative_mining=sql.NEGATIVES)
