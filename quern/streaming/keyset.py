"""A source table as a stream whose offset is a keyset cursor.

The table is a folder of Parquet files that only grows or is replaced file by file; rows change by getting a later cursor (time of
change, then key). A micro-batch is all rows above one cursor and up to another, so the engine's own logs say what has been taken
in: after a crash the same range is read again, and its output replaces what the crash left. Row groups that can't meet a range are
told by their statistics and aren't read; the driver reads footers, and the cursor columns of the row groups that hold the latest time.

The source goes to Python workers by value, so the package need not be installed there.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quern.storage import Files

TIME = "%Y-%m-%dT%H:%M:%S.%f"
#: Bytes of row groups, as they are in the files, that one task reads.
TASK_BYTES = 128 << 20
#: Rows that a task unpacks at once, and bytes of a column that it fetches at once.
BATCH_ROWS, BUFFER = 20_000, 1 << 20
#: Rows of a file that is written.
FILE_ROWS = 500_000


@dataclass
class Part(InputPartition):
    """Row groups of files, and the range that is wanted of them."""

    groups: list[tuple[str, int]]
    start: dict
    end: dict

    def __post_init__(self) -> None:
        super().__init__(None)


def as_value(v: object) -> object:
    return v.strftime(TIME) if isinstance(v, datetime) else v


class KeysetReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], names: Sequence[str]) -> None:
        self.path, self.cursor, self.initial = options["path"], options["cursor"].split(","), json.loads(options["initial"])
        self.names, self.task_bytes = list(names), int(options.get("taskbytes", TASK_BYTES))

    # files ---------------------------------------------------------------------------------------------------------

    def store(self):
        from pyarrow import fs

        if self.path.startswith(("file:", "/")):
            return fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.path)

    def footers(self) -> list[tuple[str, object]]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = self.store()
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))

        def footer(path: str) -> tuple[str, object]:
            with store.open_input_file(path) as f:
                return path, pq.ParquetFile(f).metadata

        with ThreadPoolExecutor(16) as pool:
            return list(pool.map(footer, files))

    def groups(self) -> Iterator[tuple[str, int, int, object, object]]:
        """(file, row group, bytes, least and latest time; None where the file doesn't say). Row groups without any time are left out."""
        for path, meta in self.footers():
            at = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == self.cursor[0]), None)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                said = group.column(at).statistics if at is not None else None
                if said is not None and said.has_min_max:
                    yield path, g, group.total_byte_size, as_value(said.min), as_value(said.max)
                elif said is None or not said.has_null_count or said.null_count < group.num_rows:
                    yield path, g, group.total_byte_size, None, None

    def read_group(self, path: str, group: int, columns: Sequence[str]) -> Iterator:
        """The rows of a row group, `BATCH_ROWS` at a time: unpacked whole it may be many times what it is in the file."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, _ = self.store()
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f, buffer_size=BUFFER, pre_buffer=False).iter_batches(BATCH_ROWS, row_groups=[group], columns=list(columns)):
                yield pa.Table.from_batches([batch])

    # offsets -------------------------------------------------------------------------------------------------------

    def initialOffset(self) -> dict:
        return self.initial

    def latestOffset(self) -> dict:
        import pyarrow.compute as pc

        known = list(self.groups())
        latest = max((g[4] for g in known if g[4] is not None), default=None)
        best = tuple(self.initial[c] for c in self.cursor)
        for path, group, _, _, top in known:
            if top is not None and top != latest:
                continue
            for rows in self.read_group(path, group, self.cursor):
                if len(rows) == rows[self.cursor[0]].null_count:
                    continue
                rows = rows.filter(pc.equal(rows[self.cursor[0]], pc.max(rows[self.cursor[0]])))
                for c in self.cursor[1:]:  # of the latest time the largest key
                    rows = rows.filter(pc.equal(rows[c], pc.max(rows[c])))
                if len(rows):
                    best = max(best, tuple(as_value(rows[c][0].as_py()) for c in self.cursor))
        return dict(zip(self.cursor, best))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start == end:
            return []
        time, parts, some, size = self.cursor[0], [], [], 0
        for path, group, n, low, top in self.groups():
            if top is not None and (top < start[time] or low > end[time]):
                continue
            if some and size + n > self.task_bytes:
                parts.append(Part(some, start, end))
                some, size = [], 0
            some.append((path, group))
            size += n
        return [*parts, Part(some, start, end)] if some else parts

    def read(self, partition: Part):
        import pyarrow as pa
        import pyarrow.compute as pc

        def literal(c: str, mark: dict, kind: pa.DataType) -> pa.Scalar:
            v = mark[c]
            return pa.scalar(datetime.strptime(v, TIME) if pa.types.is_timestamp(kind) else v, kind)

        def above(rows: pa.Table, mark: dict):
            """Whether the cursor lies above a mark; null where it has no time."""
            out = pa.scalar(False)
            for c in reversed(self.cursor):
                v = literal(c, mark, rows[c].type)
                out = pc.or_kleene(pc.greater(rows[c], v), pc.and_kleene(pc.equal(rows[c], v), out))
            return out

        for path, group in partition.groups:
            for rows in self.read_group(path, group, self.names):
                rows = rows.filter(pc.and_kleene(above(rows, partition.start), pc.invert(above(rows, partition.end))))
                yield from rows.select(self.names).combine_chunks().to_batches()


class KeysetSource(DataSource):
    """Options: path, cursor (columns, the time first, with commas between), initial (the cursor below all rows, as JSON), taskBytes. The schema is given."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def streamReader(self, schema) -> KeysetReader:
        return KeysetReader({k.lower(): v for k, v in self.options.items()}, schema.names)


def keyset_stream(spark: SparkSession, path: str, schema, cursor: Sequence[str], initial: dict, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows of a table as a stream in the order of batches, not of rows."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(KeysetSource)
    return spark.readStream.format("keyset").schema(schema).options(path=path, cursor=",".join(cursor), initial=json.dumps(initial), taskBytes=str(task_bytes)).load()


def ingest_keyset(
    spark: SparkSession, contract, path: str, bronze: str, checkpoint: str, run_id: str, metadata: dict[str, Column], ingested_at: Column | None = None, task_bytes: int = TASK_BYTES, fail: Callable[[str], None] = lambda step: None
) -> dict:
    """Takes in what has changed since the last run, in one job; returns status, batches, rows and jobs.

    A batch's folder is named by the date of its start and by its number, and both, like the time itself, come from the engine's
    log: a batch that is run again replaces its own folder. fail: called with each step before it, for tests that let it crash there.
    """
    rows = keyset_stream(spark, path, contract.schema(), contract.cursor, contract.to_json(contract.initial_watermark()), task_bytes)
    time = F.current_timestamp() if ingested_at is None else ingested_at  # in a stream: when the batch was begun, also if it is run again
    rows = rows.withColumns(metadata | {"_ingested_at": time.cast("timestamp_ntz")})
    names = contract.bronze_schema().names

    def write(batch: DataFrame, number: int) -> None:
        fail("write")
        folder = f"{run_id}_batch_{number + 1:06d}"
        out = batch.withColumn("_ingestion_id", F.lit(folder)).select(*names, F.to_date("_ingested_at").alias("ingestion_date"), F.lit(folder).alias("extraction_id"))
        # a batch has one folder: with a writer for each folder that is open, rows need no sort by folder; the stream's session is its own
        batch.sparkSession.conf.set("spark.sql.maxConcurrentOutputFileWriters", "4")
        out.write.partitionBy("ingestion_date", "extraction_id").options(partitionOverwriteMode="dynamic", maxRecordsPerFile=FILE_ROWS).mode("overwrite").parquet(f"{bronze}/{contract.name}")
        fail("commit")

    def run() -> tuple[list[dict], int]:
        q = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return [p for p in q.recentProgress if p["numInputRows"] > 0], len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(q.runId)))

    files = Files(spark)
    begun = set(files.names(f"{checkpoint}/offsets")) - set(files.names(f"{checkpoint}/commits"))
    done, jobs = run()
    if begun:  # a batch that a crash has left was all that this run took in
        more, again = run()
        done, jobs = done + more, jobs + again
    return {"status": "run_completed" if done else "no_new_data", "batches": len(done), "rows": sum(p["numInputRows"] for p in done), "jobs": jobs}
