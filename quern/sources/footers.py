"""Types of columns as Parquet files themselves have them, read from footers where there is room.

The function goes to Python workers by value, so the package need not be installed there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import digests


def file_types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for path in batch["path"]:
            with digests.opened(path) as f:
                out += [(path, x.name, str(x.type)) for x in pq.read_schema(f)]
        yield pd.DataFrame(out, columns=["path", "column", "type"])


def types_in(files: DataFrame) -> DataFrame:
    """(path, column, type) of each column of each file of `files` (path)."""
    for m in (sys.modules[__name__], digests):
        cloudpickle.register_pickle_by_value(m)
    dealt = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(file_types, "path string, column string, type string")


def type_name(kind: T.DataType) -> str:
    """What a column of this type is called in a file: times in microseconds, never nanoseconds, and a column of nulls keeps its type."""
    if isinstance(kind, T.DecimalType):
        return f"decimal128({kind.precision}, {kind.scale})"
    return {T.StringType(): "string", T.IntegerType(): "int32", T.LongType(): "int64", T.TimestampNTZType(): "timestamp[us]"}[kind]


def wrong_types(files: DataFrame, schema: T.StructType) -> DataFrame:
    """(column, failures): files that lack a column of the schema or have it with another type. A row for each column."""
    want = files.sparkSession.createDataFrame([(f.name, type_name(f.dataType)) for f in schema], "column string, want string")
    found = types_in(files).withColumnRenamed("type", "has")
    right = found.join(F.broadcast(want), "column").where("has = want").groupBy("column").agg(F.count(F.lit(1)).alias("right"))
    n = files.agg(F.count(F.lit(1)).alias("files"))
    return want.join(right, "column", "left").join(F.broadcast(n)).select("column", (F.col("files") - F.coalesce("right", F.lit(0))).alias("failures"))
