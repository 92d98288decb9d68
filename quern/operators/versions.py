"""Versions of rows: the latest of each key, what has changed, and merging changes into a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def any_null(columns: Sequence[str]) -> Column:
    """Whether a row lacks part of its key."""
    return reduce(or_, [F.col(c).isNull() for c in columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], clustered_by: str | None = None) -> DataFrame:
    """One row of each key: the largest by `order`, nulls last.

    Spark keeps one row of a key in each task before the shuffle. clustered_by: a part of the key by which rows are
    dealt out instead, so that later steps on that part need no further shuffle.
    """
    require_columns(df, [*keys, *order])
    if clustered_by:
        df = df.repartition(clustered_by)
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_state(bronze: DataFrame, keys: Sequence[str], watermark: str = "updated_at", ingested: str = "_ingested_at") -> DataFrame:
    """`latest` by watermark, then ingestion time, then all other columns, so that ties have one outcome. Rows without a full key are refused."""
    rest = [c for c, t in bronze.dtypes if c not in (*keys, watermark, ingested) and not t.startswith("map")]
    checked = bronze.withColumn("__key", F.when(any_null(keys), F.raise_error(F.lit(f"null in key {', '.join(keys)}"))))
    return latest(checked.where(F.col("__key").isNull()).drop("__key"), keys, [watermark, ingested, *rest])


def is_newer(source: str, target: str, watermark: str, ingested: str) -> Column:
    """Source row is newer: later watermark, or the same one ingested later. A target without either counts as older."""
    s, t = (lambda a: lambda c: F.col(f"{a}.{c}"))(source), (lambda a: lambda c: F.col(f"{a}.{c}"))(target)
    same = s(watermark).eqNullSafe(t(watermark))
    return F.coalesce(
        (t(watermark).isNull() & s(watermark).isNotNull()) | (s(watermark) > t(watermark)) | (same & ((t(ingested).isNull() & s(ingested).isNotNull()) | (s(ingested) > t(ingested)))),
        F.lit(False),
    )


def changes(source: DataFrame, target: DataFrame, keys: Sequence[str], watermark: str = "updated_at", ingested: str = "_ingested_at") -> DataFrame:
    """Rows of the source that are new or newer than the target's. Only keys and the two time columns of the target are read."""
    narrow = target.select(*keys, watermark, ingested, F.lit(True).alias("__there"))
    on = reduce(and_, [F.col(f"source.{k}") == F.col(f"target.{k}") for k in keys])
    joined = source.alias("source").join(narrow.alias("target"), on, "left")
    return joined.where(F.col("target.__there").isNull() | is_newer("source", "target", watermark, ingested)).select("source.*")


def merged(target: DataFrame, applied: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: the applied rows replace those with their key. One applied row for each key."""
    return target.join(applied.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(applied.select(*target.columns))


def merge_newer(target: DataFrame, source: DataFrame, keys: Sequence[str], watermark: str = "updated_at", ingested: str = "_ingested_at") -> DataFrame:
    """Update where newer, insert where new, leave the rest.

    A union and one row of each key, which needs one shuffle: a target row wins ties against the source.
    """
    both = target.withColumn("__source", F.lit(0)).unionByName(source.select(*target.columns).withColumn("__source", F.lit(1)))
    w = W.partitionBy(*keys).orderBy(F.col(watermark).desc_nulls_last(), F.col(ingested).desc_nulls_last(), F.col("__source"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__source")


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the source whose key the target lacks."""
    return source.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti").select(*source.columns)


def first_of_group(df: DataFrame, key: str, order: str, ties: Sequence[str]) -> DataFrame:
    """First row of each key by `order` descending, nulls last; ties by the given columns, descending."""
    return latest(df, [key], [order, *ties])


def keyset_predicate(columns: Sequence[str], bound: Sequence[object], op: str) -> Column:
    """(columns) > bound or <= bound in dictionary order, as comparisons of single columns that reach the Parquet scan."""
    if op not in (">", "<="):
        raise ValueError(op)
    cols = [F.col(c) for c in columns]
    last = cols[-1] > bound[-1] if op == ">" else cols[-1] <= bound[-1]
    for c, v in zip(reversed(cols[:-1]), reversed(bound[:-1]), strict=True):
        last = (c > v if op == ">" else c < v) | ((c == F.lit(v)) & last)
    # the bound on the first column alone prunes row groups
    return (cols[0] >= bound[0] if op == ">" else cols[0] <= bound[0]) & last


def keyset_batch(df: DataFrame, cursor: Sequence[str], lower: Sequence[object] | None, upper: Sequence[object], size: int) -> DataFrame:
    """The next `size` rows above `lower` and up to `upper` in cursor order; rows without a watermark are never in a batch."""
    rows = df.where(F.col(cursor[0]).isNotNull() & keyset_predicate(cursor, upper, "<="))
    if lower is not None:
        rows = rows.where(keyset_predicate(cursor, lower, ">"))
    return rows.orderBy(*cursor).limit(size)


def upper_watermark(df: DataFrame, cursor: Sequence[str]) -> DataFrame:
    """The largest cursor in one pass without a sort; no row if there is none."""
    return df.where(F.col(cursor[0]).isNotNull()).agg(F.max(F.struct(*cursor)).alias("w")).where("w is not null").select("w.*")
