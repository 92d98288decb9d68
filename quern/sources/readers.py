"""Readers: raw layer, text files with strict columns, hourly JSON, file discovery, committed units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import METADATA, TYPES, TableContract
from quern.operators.clickstream import RAW
from quern.operators.weather import METADATA_SCHEMA, RESPONSE_SCHEMA
from quern.sources.digests import digested
from quern.storage import Files


def read_bronze(spark: SparkSession, contract: TableContract, root: str) -> DataFrame:
    """Raw rows of a table by its contract; folder names do not become columns."""
    df = spark.read.schema(contract.bronze_schema()).option("recursiveFileLookup", True).parquet(f"{root}/{contract.name}")
    return df.select(*contract.columns, *METADATA)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> ''")


def read_clicks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Four strings for each record, without a header, quoted where need be; another number of fields is an error, empty fields stay empty strings."""
    schema = ", ".join(f"{c} string" for c in (*RAW, "_bad"))
    df = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", escape='"').csv(path)
    checked = F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("not four fields: "), "_bad")).cast("string")).otherwise(F.coalesce(RAW[0], F.lit("")))
    return df.select(checked.alias(RAW[0]), *[F.coalesce(c, F.lit("")).alias(c) for c in RAW[1:]])


def read_responses(spark: SparkSession, units: Sequence[str]) -> DataFrame:
    """Responses of committed units, with the id that their folder names."""
    from quern.operators.weather import with_ingestion_id

    return with_ingestion_id(spark.read.schema(RESPONSE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json([f"{u}/response.json" for u in units]))


def read_metadata(spark: SparkSession, units: Sequence[str]) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json([f"{u}/metadata.json" for u in units])


def listed(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path, relative_path, size, last_modified) of the files below a folder; no contents are read. Files without a byte are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    return files.select("path", F.substring_index("path", base, -1).alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def discover(spark: SparkSession, root: str, pattern: str = "*.csv", known: DataFrame | None = None) -> DataFrame:
    """(relative_path, etag, size, last_modified) of the files below a folder, by path; the etag is that of the contents, by blocks.

    known: (relative_path, size, last_modified, etag) of files seen before. Where size and time of change are the same, the
    known etag stands and the file isn't read.
    """
    found, columns = listed(spark, root, pattern), ["relative_path", "etag", "size", "last_modified"]
    if known is None:
        return digested(found).select(*columns).orderBy("relative_path")
    seen = found.join(known.select(*columns), ["relative_path", "size", "last_modified"], "left")
    new = digested(seen.where("etag is null").drop("etag"))
    return seen.where("etag is not null").select(*columns).unionByName(new.select(*columns)).orderBy("relative_path")


def committed_units(spark: SparkSession, root: str) -> list[str]:
    """Folders with the marker of a complete unit, sorted."""
    return Files(spark).walk(root, "_SUCCESS")


def read_seed(spark: SparkSession, contract: TableContract, path: str, **constants: str) -> DataFrame:
    """A CSV with a header as a source table; columns that the file lacks come from `constants`."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    for c, v in constants.items():
        df = df.withColumn(c, F.lit(v))
    return df.select(*[F.col(c).cast(TYPES[t]).alias(c) if c in df.columns else F.lit(None).cast(TYPES[t]).alias(c) for c, t in contract.columns.items()])
