"""File ingestion by manifest: NEW, then PENDING, then PROCESSED; a file that is pending after a crash is taken in again under its old id."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import TIME_FORMAT
from quern.functions.scalar import request_id, utc_now
from quern.storage import Files

from .readers import discover, read_clicks

STATUSES = ("PENDING", "PROCESSED")


class Manifest:
    """Entries by (path, etag), in one JSON file that is replaced whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.files = path, Files(spark)
        self.entries: dict[tuple[str, str], dict] = {}
        if self.files.exists(path):
            data = json.loads(self.files.read(path))
            if data.get("version") != 1:
                raise ValueError(f"{path}: unknown version")
            for e in data["entries"]:
                if e["status"] not in STATUSES:
                    raise ValueError(f"{path}: status {e['status']!r}")
                self.entries[e["relative_path"], e["etag"]] = e

    def save(self) -> None:
        self.files.write(self.path, json.dumps({"version": 1, "entries": [self.entries[k] for k in sorted(self.entries)]}))

    def known(self, spark: SparkSession) -> DataFrame:
        """What is known of processed files, so that they need not be read again to see that they are the same."""
        rows = [(e["relative_path"], e["size"], e["last_modified"], e["etag"]) for e in self.entries.values() if e["status"] == "PROCESSED"]
        return spark.createDataFrame(rows, "relative_path string, size long, last_modified string, etag string").withColumn("last_modified", F.to_timestamp("last_modified"))

    def changed(self, path: str, etag: str) -> bool:
        return any(p == path and e != etag for p, e in self.entries)


def ingest_files(spark: SparkSession, landing: str, bronze: str, manifest_path: str, source_name: str = "clicks", now: Callable[[], datetime] = utc_now, fail: Callable[[str], None] = lambda step: None) -> dict[str, int]:
    """Takes in the files that the manifest doesn't have as processed. Returns how many were new, retried and skipped."""
    manifest, tally = Manifest(spark, manifest_path), {"new": 0, "retried": 0, "skipped": 0}
    for f in discover(spark, landing, known=manifest.known(spark)).toLocalIterator():  # a row a file, streamed
        key = f["relative_path"], f["etag"]
        e = manifest.entries.get(key)
        if e and e["status"] == "PROCESSED":
            tally["skipped"] += 1
            continue
        if e is None and manifest.changed(*key):
            raise ValueError(f"{key[0]} has changed since it was taken in")
        if e is None:
            e = {"relative_path": key[0], "etag": key[1], "size": f["size"], "last_modified": str(f["last_modified"]), "status": "PENDING", "ingestion_id": request_id(source_name, *key), "discovered_at": now().strftime(TIME_FORMAT)}
            manifest.entries[key] = e
            tally["new"] += 1
        else:
            tally["retried"] += 1
        fail("pending")
        manifest.save()
        fail("write")
        meta = {"_source_name": source_name, "_source_file_path": key[0], "_source_file_etag": key[1], "_source_file_last_modified": e["last_modified"], "_source_file_size": e["size"], "_ingestion_id": e["ingestion_id"], "_ingested_at": e["discovered_at"], "_ingestion_method": "file_incremental"}
        rows = read_clicks(spark, f"{landing}/{key[0]}").select("*", *[F.lit(v).alias(c) for c, v in meta.items()])
        rows = rows.withColumn("_source_file_last_modified", F.to_timestamp("_source_file_last_modified")).withColumn("_ingested_at", F.to_timestamp("_ingested_at"))
        rows.write.mode("overwrite").option("compression", "snappy").parquet(f"{bronze}/ingestion_date={e['discovered_at'][:10]}/ingestion_id={e['ingestion_id']}")
        fail("processed")
        manifest.entries[key] = e | {"status": "PROCESSED", "processed_at": now().strftime(TIME_FORMAT)}
        manifest.save()
    return tally


def first_lines(spark: SparkSession, raw: str, n: int) -> DataFrame:
    """(value): the first `n` lines that aren't empty, files in the order of their names.

    Lines are counted by the blocks that files are read in (a row a block reaches the driver); a block is then taken whole, in part or not at all.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(raw).select("value", *block, F.monotonically_increasing_id().alias("id")).where("value <> ''")
    # lines of a block are numbered in order, in the task that reads it
    sizes = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).orderBy("file", "block").collect()
    some, left = [], n
    for r in sizes:
        if left > 0:
            some.append((r["file"], r["block"], min(r["n"], left), r["n"] > left))
            left -= r["n"]
    taken = spark.createDataFrame(some, "file string, block long, wanted long, cut boolean")
    met = lines.join(F.broadcast(taken), ["file", "block"])
    cut = met.where("cut")  # one block at most
    part = cut.orderBy("id").limit(next((r[2] for r in some if r[3]), 0))
    return met.where("not cut").select("value").unionByName(part.select("value"))


def split_by_date(spark: SparkSession, raw: str, target: str, chunk_lines: int = 250_000, max_chunks: int | None = None) -> None:
    """Raw lines into a folder for each date, as they are, in files of at most `chunk_lines`; with `max_chunks` only the first so many chunks of lines."""
    lines = spark.read.text(raw).where("value <> ''") if max_chunks is None else first_lines(spark, raw, chunk_lines * max_chunks)
    dated = lines.withColumn("event_date", F.substring(F.split_part("value", F.lit(","), F.lit(2)), 1, 10))
    dated.write.mode("overwrite").option("maxRecordsPerFile", chunk_lines).partitionBy("event_date").text(target)


def upload_landing(spark: SparkSession, source: str, landing: str, pattern: str = "*.csv") -> dict[str, int]:
    """Copies files into the landing folder. One of the same size is skipped, one of another size is an error; each copy's size is verified."""
    from .readers import listed

    files, tally = Files(spark), {"uploaded": 0, "skipped": 0}
    for f in listed(spark, source, pattern).orderBy("relative_path").toLocalIterator():  # a row a file, streamed
        place = f"{landing}/{f['relative_path']}"
        if files.exists(place):
            if files.size(place) != f["size"]:
                raise ValueError(f"{f['relative_path']} has {files.size(place)} bytes in landing, {f['size']} at its source")
            tally["skipped"] += 1
            continue
        files.copy(f["path"], place)
        if files.size(place) != f["size"]:
            files.delete(place)
            raise OSError(f"{f['relative_path']} was not copied whole")
        tally["uploaded"] += 1
    return tally
