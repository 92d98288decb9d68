"""Cleaned tables as plain partitioned Parquet: a merge reads and writes only the partitions that its rows lie in.

The partition follows from a row's own columns (a month, a range of numbers) and stays the same for a key. A merge finds the partitions
of the changes, reads those alone, and overwrites those alone (dynamic partition overwrite). Writing is idempotent: a merge that a
crash has cut off, whatever partitions it had replaced, is finished by running it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import versions as R
from quern.operators.quality import QualityError
from quern.storage import Files

#: The partition column; it is a folder's name, not a column of the table.
PART = "__part"
NONE = "none"


def by_month(column: str) -> Column:
    """A partition for each month, and one for rows without a time."""
    return F.coalesce(F.date_format(column, "yyyy-MM"), F.lit(NONE))


def by_range(column: str, width: int) -> Column:
    """A partition for each range of whole numbers."""
    return F.coalesce(F.floor(F.col(column).cast("decimal(38,0)") / width).cast("string"), F.lit(NONE))


@dataclass(frozen=True)
class Merge:
    """What a merge has done: rows applied, partitions written, rows in them."""

    applied: int
    partitions: tuple[str, ...] = ()
    written: int = 0


class PartitionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], part: Column, watermark: str = "updated_at", ingested: str = "_ingested_at") -> None:
        self.spark, self.path, self.schema, self.keys, self.part, self.watermark, self.ingested, self.files = spark, path.rstrip("/"), schema, list(keys), part, watermark, ingested, Files(spark)

    def exists(self) -> bool:
        return any(n.startswith(f"{PART}=") for n in self.files.names(self.path))

    def rows(self) -> DataFrame:
        """The table with its partition column, by which a filter prunes folders."""
        if not self.exists():
            return self.spark.createDataFrame([], T.StructType([*self.schema, T.StructField(PART, T.StringType())]))
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField(PART, T.StringType())])).parquet(self.path)

    def read(self) -> DataFrame:
        return self.rows().drop(PART)

    def of(self, partitions: Sequence[str]) -> DataFrame:
        return self.rows().where(F.col(PART).isin(list(partitions)))

    def last(self) -> object:
        """The latest time of ingestion; answered from footers."""
        return self.read().agg(F.max(self.ingested)).first()[0]

    def write(self, rows: DataFrame) -> int:
        """Replaces the partitions of `rows`; returns how many rows were written."""
        seen = Observation()
        counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.partitionBy(PART).options(partitionOverwriteMode="dynamic", maxRecordsPerFile=500_000).mode("overwrite").parquet(self.path)
        return seen.get["rows"]

    def merge(self, source: DataFrame, check_moves: bool = False) -> Merge:
        """Applies what is new or newer. check_moves: refuses a change whose key lies in another partition, for which the key columns of the whole table are read."""
        rows = source.select(*self.schema.names).withColumn(PART, self.part)
        beside = f"{self.path}/_changes-{uuid.uuid4().hex}"
        try:
            if not self.exists():
                changes = rows
            else:
                near = [r[0] for r in rows.select(PART).distinct().collect()]  # a row a partition
                changes = R.changes(rows, self.of(near), self.keys, self.watermark, self.ingested)
            seen = Observation()
            changes.observe(seen, F.count_if(R.any_null(self.keys)).alias("null_keys"), F.count_if(F.col(PART).isNull()).alias("no_part")).write.parquet(beside)
            if any(seen.get.values()):
                raise QualityError(f"rows without a key or a partition: {seen.get}")
            applied = self.spark.read.schema(T.StructType([*self.schema, T.StructField(PART, T.StringType())])).parquet(beside)
            by_part = applied.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"), F.min(PART).alias(PART)).groupBy(PART).agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
            if any(r["most"] > 1 for r in by_part):
                raise QualityError("several source rows for a key")
            if not by_part:
                return Merge(0)
            touched = sorted(r[PART] for r in by_part)
            if check_moves and self.exists():
                moved = self.rows().select(*self.keys, F.col(PART).alias("__old")).join(applied.select(*self.keys, PART), self.keys).where(F.col("__old") != F.col(PART))
                if not moved.isEmpty():
                    raise QualityError(f"a key has moved to another partition: {moved.first()}")
            out = R.merged(self.of(touched), applied, self.keys) if self.exists() else applied
            n = self.write(out.repartition(PART, F.pmod(F.xxhash64(*self.keys), F.lit(4))))
            return Merge(sum(r["n"] for r in by_part), tuple(touched), n)
        finally:
            self.files.delete(beside)
