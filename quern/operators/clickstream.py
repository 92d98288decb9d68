"""Click events from raw strings to typed rows, for source files that have not been taken in yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import path_date

RAW = ("session_id", "event_timestamp", "item_id", "category")
LINEAGE = ("_source_name", "_source_file_path", "_source_file_etag", "_source_file_last_modified", "_source_file_size", "_ingestion_id", "_ingested_at", "_ingestion_method")
#: A set of new files up to this many rows is broadcast.
BROADCAST_ROWS = 100_000


def typed_events(bronze: DataFrame) -> DataFrame:
    """Strings that don't parse become null and are left to the checks."""
    ts = F.try_to_timestamp("event_timestamp")
    lineage = [c for c in LINEAGE if c in bronze.columns]
    extra = [path_date(F.col("_source_file_path")).alias("_source_event_date")] if "_source_file_path" in lineage else []
    return bronze.select(
        F.col("session_id").try_cast("long").alias("session_id"), ts.alias("event_timestamp"), F.to_date(ts).alias("event_date"), F.hour(ts).alias("event_hour"), F.col("item_id").try_cast("long").alias("item_id"), F.trim("category").alias("category"), *lineage, *extra
    )


def changed_sources(sources: DataFrame, processed: DataFrame) -> DataFrame:
    """Files that were taken in with other contents."""
    s, p = sources.select("_source_file_path", "_source_file_etag").distinct(), processed.select("_source_file_path", F.col("_source_file_etag").alias("known_etag")).distinct()
    return s.join(p, "_source_file_path").where("_source_file_etag <> known_etag")


def new_sources(sources: DataFrame, processed: DataFrame) -> DataFrame:
    keys = ["_source_file_path", "_source_file_etag"]
    return sources.select(*keys).distinct().join(processed.select(*keys).distinct(), keys, "left_anti")


def of_sources(events: DataFrame, sources: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Events of the given files; the files are broadcast if they are few, else joined by a shuffle."""
    few = sources.limit(limit + 1).count() <= limit
    return events.join(F.broadcast(sources) if few else sources, ["_source_file_path", "_source_file_etag"])


def unseen_events(bronze: DataFrame, processed: DataFrame) -> DataFrame:
    """Typed events of files that are new. Raises if a file has changed since it was taken in."""
    changed = changed_sources(bronze, processed)
    if not changed.isEmpty():
        raise ValueError(f"a source file has changed: {changed.first()['_source_file_path']}")
    return typed_events(of_sources(bronze, new_sources(bronze, processed)))


def write_events(events: DataFrame, path: str, partitions: int = 128, mode: str = "append") -> None:
    """By date, in files of a bounded number of rows. Rows of a date are spread, so that a large date isn't one task."""
    rows = events.repartition(partitions, "event_date", F.pmod(F.xxhash64("session_id"), F.lit(16)))
    rows.write.mode(mode).option("maxRecordsPerFile", 500_000).partitionBy("event_date").parquet(path)


def valid_lines(lines: DataFrame) -> DataFrame:
    """Raw lines with the reason why they are invalid, null for good ones. lines: (value)."""
    part = F.split("value", ",")
    get = lambda i: F.get(part, F.lit(i))
    reason = (
        F.when(F.size(part) != 4, "fields").when(~get(0).rlike("^[0-9]+$"), "session_id").when(F.try_to_timestamp(get(1)).isNull(), "event_timestamp")
        .when(~get(2).rlike("^[0-9]+$"), "item_id").when(F.trim(get(3)) == "", "category")
    )
    return lines.select("value", reason.alias("reason"))


def out_of_order(lines: DataFrame, position: str = "position") -> DataFrame:
    """Lines with an earlier date than a line before them, by file position: a running maximum over blocks of lines.

    Blocks are summed up first; only their maxima are ordered in one place.
    """
    from pyspark.sql import Window as W

    d = lines.withColumn("d", F.substring(F.split_part("value", F.lit(","), F.lit(2)), 1, 10)).withColumn("block", F.floor(F.col(position) / 1_000_000))
    tops = d.groupBy("block").agg(F.max("d").alias("top")).withColumn("before", F.max("top").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))).select("block", "before")
    inside = F.max("d").over(W.partitionBy("block").orderBy(position).rowsBetween(W.unboundedPreceding, -1))
    return d.withColumn("inside", inside).join(tops, "block").where("d < greatest(inside, before)").select(position, "value")
