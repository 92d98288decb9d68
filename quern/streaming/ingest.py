"""File ingestion as a stream: every file once, in one micro-batch after another, until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.places import work_dir


def ingest_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, pattern: str | None = None, fmt: str = "parquet") -> int:
    """Takes in the files that the checkpoint doesn't know; returns the number of micro-batches.

    A batch that is run again after a crash overwrites its own folder, so no row is taken in twice.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_ingested_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id:09d}")

    q = reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len([p for p in q.recentProgress if p["numInputRows"] > 0])


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by window of event time; rows later than the watermark are left out once their window is done."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("event_count"))


def daily_counts_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream into a table, then counted by day."""
    place = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    folder = any(f.rsplit("/", 2)[-2] == "events.parquet" for f in table.inputFiles())
    source, pattern = (f"{sf_dir}/events.parquet", "*.parquet") if folder else (sf_dir, "events.parquet")
    ingest_new_files(spark, source, schema, f"{place}/table", f"{place}/checkpoint", pattern)
    return spark.read.parquet(f"{place}/table").groupBy(F.to_date("ts").alias("event_date")).agg(F.count(F.lit(1)).alias("event_count"))
