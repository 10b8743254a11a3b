"""Scans: binary files with facts first, page corpora, nested events, keyed tables, package metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import rules

CUSTOMERS = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])


def file_facts(listing: DataFrame, name: str, length: str, head: str, ceiling: int = rules.CEILING_BYTES) -> DataFrame:
    """Every file's name, size, container and verdict from a listing that holds its leading bytes. Files over the
    ceiling are refused by size; nothing is left out."""
    return listing.select(F.col(name).alias("name"), F.col(length).alias("length"), rules.sniff(head).alias("container"), rules.intake(length, head, ceiling).alias("refused"))


def quality_violations(rows: DataFrame, not_null: list[str], checks: dict[str, str]) -> DataFrame:
    """Declared constraints as a column of broken ones; nothing is dropped."""
    broken = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in not_null]
    broken += [F.when(~F.coalesce(F.expr(e), F.lit(False)), F.lit(name)) for name, e in checks.items()]
    return rows.withColumn("violations", F.array_join(F.array_compact(F.array(*broken)), "; "))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """One metadata file per package."""
    return package_licences(spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path), "value")


def package_licences(metadata: DataFrame, text: str) -> DataFrame:
    """Package name, version and one licence text, from a string, an object's type or an array."""
    d = metadata.withColumn("_p", F.from_json(text, "name string, version string, license string, licenses array<string>"))
    kind = F.when(F.col("_p.license").startswith("{"), F.get_json_object("_p.license", "$.type"))
    plain = F.when(~F.col("_p.license").startswith("{"), F.col("_p.license"))
    many = F.transform("_p.licenses", lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.type")).otherwise(x))
    return d.where("_p.name is not null").select("_p.name", "_p.version", rules.licence_text(plain, kind, many).alias("licence"))


def event_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the parquet files of a table, be it a folder of files or one file, a bounded number per
    micro-batch. What is built on it must not depend on that number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return stream.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return stream.parquet(path)
