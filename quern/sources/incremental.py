"""Incremental ingestion of a source table in keyset batches that survives a crash at any point.

A batch goes through five steps: read, note it as pending, write its raw folder, move the checkpoint, drop the note. Batches are written beside,
several at once, and take their folder's name when it is their turn; what a crash leaves there is written over. All
that a batch needs to be made again (bounds, size, ids, time) is in the note, so a batch that is run again writes the
same rows to the same folder.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import TIME_FORMAT, TYPES, TableContract
from quern.functions.scalar import safe_run_id, utc_now
from quern.operators.versions import any_null, keyset_batch, keyset_predicate, upper_watermark
from quern.sources.footers import wrong_types
from quern.sources.readers import listed
from quern.storage import Files

#: Batches that are written at once; each is one task.
MOST_AHEAD = 16
METHOD = "timestamp_incremental"
#: Columns of staged rows: their place in cursor order, and the number of their batch.
PLACE, BATCH = "__place", "__batch"


class StateError(ValueError):
    """Control state that doesn't fit together; nothing has been written."""


@dataclass(frozen=True)
class Pending:
    """A batch that has begun."""

    run_id: str
    run_upper: dict
    lower: dict
    batch_upper: dict
    extraction_id: str
    ingested_at: str
    batch_size: int


class State:
    """Checkpoint and pending note of a table, as JSON files that are replaced whole."""

    def __init__(self, spark: SparkSession, contract: TableContract, root: str) -> None:
        self.contract, self.files = contract, Files(spark)
        self.checkpoint_path, self.pending_path = f"{root}/checkpoints/{contract.name}.json", f"{root}/pending/{contract.name}.json"

    def load(self, path: str) -> dict | None:
        if not self.files.exists(path):
            return None
        try:
            data = json.loads(self.files.read(path))
        except ValueError as e:
            raise StateError(f"{path} is no JSON") from e
        if not isinstance(data, dict) or data.get("version") != 1 or data.get("table_name") != self.contract.name:
            raise StateError(f"{path} isn't version 1 of {self.contract.name}")
        return data

    def checkpoint(self) -> dict:
        data = self.load(self.checkpoint_path)
        if data is None:
            return self.contract.initial_watermark()
        try:
            return self.contract.from_json(data.get("watermark") or {})
        except ValueError as e:
            raise StateError(str(e)) from e

    def save_checkpoint(self, mark: dict) -> None:
        self.files.write(self.checkpoint_path, json.dumps({"version": 1, "table_name": self.contract.name, "watermark": self.contract.to_json(mark)}))

    def pending(self) -> Pending | None:
        data = self.load(self.pending_path)
        if data is None:
            return None
        try:
            p = Pending(data["run_id"], *(self.contract.from_json(data[k]) for k in ("run_upper", "lower", "batch_upper")), data["extraction_id"], data["ingested_at"], data["batch_size"])
            datetime.strptime(p.ingested_at, TIME_FORMAT)
        except (KeyError, TypeError, ValueError) as e:
            raise StateError(f"{self.pending_path}: {e}") from e
        self.check(p)
        return p

    def check(self, p: Pending) -> None:
        order = self.contract.order
        if not isinstance(p.batch_size, int) or isinstance(p.batch_size, bool) or p.batch_size < 1:
            raise StateError(f"batch size {p.batch_size!r}")
        if not order(p.lower) < order(p.batch_upper) <= order(p.run_upper):
            raise StateError("a batch lies above its lower bound and not above the run's upper bound")
        if not all(isinstance(x, str) and x for x in (p.run_id, p.extraction_id)):
            raise StateError("a batch has a run id and an extraction id")

    def save_pending(self, p: Pending) -> None:
        self.check(p)
        marks = {k: self.contract.to_json(getattr(p, k)) for k in ("run_upper", "lower", "batch_upper")}
        self.files.write(self.pending_path, json.dumps({"version": 1, "table_name": self.contract.name, "run_id": p.run_id, "extraction_id": p.extraction_id, "ingested_at": p.ingested_at, "batch_size": p.batch_size} | marks))

    def drop_pending(self) -> None:
        self.files.delete(self.pending_path)


class Ingestion:
    """Runs batches from a source frame into a raw folder.

    now: the clock. fail: called with the name of each step before it, for tests that let it crash there.
    """

    def __init__(self, spark: SparkSession, contract: TableContract, source: Callable[[], DataFrame], bronze: str, state: str, batch_size: int = 5000, now: Callable[[], datetime] = utc_now, fail: Callable[[str], None] = lambda step: None) -> None:
        if not isinstance(batch_size, int) or isinstance(batch_size, bool) or batch_size < 1:
            raise ValueError(f"batch size {batch_size!r}")
        self.spark, self.contract, self.source, self.bronze, self.batch_size, self.now, self.fail = spark, contract, source, bronze, batch_size, now, fail
        self.root, self.state = state, State(spark, contract, state)

    def mark_of(self, row) -> dict | None:
        return None if row is None else {c: row[c] for c in self.contract.cursor}

    def upper(self, df: DataFrame) -> dict | None:
        return self.mark_of(upper_watermark(df, self.contract.cursor).first())

    def batch(self, lower: dict, upper: dict, size: int) -> DataFrame:
        o = self.contract.order
        return keyset_batch(self.contract.select(self.source()), self.contract.cursor, o(lower), o(upper), size)

    def folder(self, p: Pending) -> str:
        return f"{self.bronze}/{self.contract.name}/ingestion_date={p.ingested_at[:10]}/extraction_id={p.extraction_id}"

    def write(self, rows: DataFrame, p: Pending, folder: str) -> None:
        values = {"_ingestion_id": p.extraction_id, "_ingested_at": datetime.strptime(p.ingested_at, TIME_FORMAT), "_source_table": self.contract.name, "_ingestion_method": METHOD}
        out = rows.withColumn("_source_updated_at", F.col(self.contract.watermark))
        for c, v in values.items():
            out = out.withColumn(c, F.lit(v).cast(TYPES["timestamp_us"] if c == "_ingested_at" else TYPES["string"]))
        out.select(*self.contract.bronze_schema().names).coalesce(1).write.mode("overwrite").parquet(folder)

    def finish(self, p: Pending, write: Callable[[], None]) -> None:
        self.fail("write")
        write()
        self.fail("checkpoint")
        self.state.save_checkpoint(p.batch_upper)
        self.fail("drop")
        self.state.drop_pending()

    def recover(self, checkpoint: dict) -> tuple[dict, int]:
        """Ends a batch that a crash has left: makes it again, or only drops its note if its checkpoint was reached."""
        p = self.state.pending()
        if p is None:
            return checkpoint, 0
        if p.batch_upper == checkpoint:
            self.state.drop_pending()
            return checkpoint, 0
        if p.lower != checkpoint:
            raise StateError("the pending batch neither begins nor ends at the checkpoint")
        rows = self.batch(p.lower, p.batch_upper, p.batch_size)
        end = self.upper(rows)
        if end != p.batch_upper:
            raise StateError(f"the pending batch now ends at {end}, not at {p.batch_upper}")
        self.finish(p, lambda: self.write(rows, p, self.folder(p)))
        return p.batch_upper, 1

    def staged(self, checkpoint: dict, top: dict) -> DataFrame:
        """The source's rows above the checkpoint and up to `top`, written once in cursor order, with the number of their batch.

        The source is read once for all batches of a run, and what a batch writes can't change while it does.
        """
        o, cursor = self.contract.order, self.contract.cursor
        rows = self.contract.select(self.source())
        rows = rows.where(F.col(cursor[0]).isNotNull() & keyset_predicate(cursor, o(top), "<=") & keyset_predicate(cursor, o(checkpoint), ">"))
        place = f"{self.root}/staged/{self.contract.name}"
        rows.orderBy(*cursor).withColumn(PLACE, F.monotonically_increasing_id()).write.mode("overwrite").parquet(place)
        got = self.spark.read.parquet(place)
        # sorted parts are numbered in order; a part's first place is the number of rows before it
        part, inside = F.shiftright(F.col(PLACE), 33), F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
        sizes = got.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a part
        starts, before = [], 0
        for r in sizes:
            starts.append((r["part"], before))
            before += r["count"]
        ahead = F.broadcast(self.spark.createDataFrame(starts, "part long, ahead long"))
        number = F.floor((F.col("ahead") + inside) / self.batch_size).alias(BATCH)
        return got.join(ahead, part == F.col("part")).select(*self.contract.columns, number)

    def run(self, run_id: str) -> dict:
        """All batches up to the largest cursor at the start. Returns the status and the number of batches."""
        checkpoint = self.state.checkpoint()
        top = self.upper(self.contract.select(self.source()))
        checkpoint, replayed = self.recover(checkpoint)
        order = self.contract.order
        if top is None:
            return {"status": "source_empty", "batches": 0, "replayed": replayed}
        if order(checkpoint) > order(top):
            raise StateError("the checkpoint lies above the source")
        if checkpoint == top:
            return {"status": "run_completed" if replayed else "no_new_data", "batches": 0, "replayed": replayed}
        n, safe, files = 0, safe_run_id(run_id), Files(self.spark)
        taken = [int(x.rsplit("_", 1)[1]) for d in files.names(f"{self.bronze}/{self.contract.name}") for x in files.names(f"{self.bronze}/{self.contract.name}/{d}") if x.startswith(f"extraction_id={safe}_batch_")]
        number = max(taken, default=0)
        self.fail("read")
        for left in files.names(f"{self.root}/staged"):  # by a run that a crash has ended
            if left.startswith(f"{self.contract.name}-"):
                files.delete(f"{self.root}/staged/{left}")
        staged = self.staged(checkpoint, top)
        cursor = self.contract.cursor
        ends = staged.groupBy(BATCH).agg(F.max(F.struct(*cursor)).alias("end")).orderBy(BATCH).select("end.*").toLocalIterator()  # a row a batch, streamed
        ready = lambda p: f"{self.root}/staged/{self.contract.name}-{p.extraction_id}"
        ahead: deque[tuple[Pending, Future]] = deque()  # batches that are being written beside, while those before them are ended in order
        most = max(1, min(MOST_AHEAD, self.spark.sparkContext.defaultParallelism))
        with ThreadPoolExecutor(most) as pool:
            try:
                begun, r = checkpoint, next(ends, None)
                while r is not None or ahead:
                    while r is not None and len(ahead) < most:
                        end = self.mark_of(r)
                        if order(end) <= order(begun):
                            raise StateError("a batch must move the cursor")
                        rows = staged.where(keyset_predicate(cursor, order(begun), ">") & keyset_predicate(cursor, order(end), "<=")).drop(BATCH)
                        number += 1
                        p = Pending(run_id, top, begun, end, f"{safe}_batch_{number:06d}", self.now().strftime(TIME_FORMAT), self.batch_size)
                        ahead.append((p, pool.submit(inheritable_thread_target(self.spark)(self.write), rows, p, ready(p))))
                        begun, r = end, next(ends, None)
                    p, written = ahead.popleft()
                    self.fail("pending")
                    self.state.save_pending(p)
                    written.result()
                    self.finish(p, lambda p=p: files.move(ready(p), self.folder(p)))
                    n, checkpoint = n + 1, p.batch_upper
            finally:
                for _, w in ahead:
                    w.cancel()
        if checkpoint != top:
            raise StateError("the batches don't reach the upper bound of the run")
        files.delete(f"{self.root}/staged/{self.contract.name}")
        return {"status": "run_completed", "batches": n, "replayed": replayed}


def bronze_checks(spark: SparkSession, contract: TableContract, source: DataFrame, bronze: str, state: str, ignored: str = "test_") -> DataFrame:
    """(check_name, failures) of a raw table against its source and control state, end to end.

    Folders are those of dates and extractions, metadata says where rows come from, every key of the source is there, and the
    checkpoint, the largest raw cursor and the source's agree, with no batch pending. Extractions whose id begins with `ignored` don't count.
    """
    control, keys = State(spark, contract, state), contract.key
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(contract.bronze_schema()).option("recursiveFileLookup", True).parquet(f"{bronze}/{contract.name}").withColumn("__path", path)
    folder = rf"/{contract.name}/ingestion_date=([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/extraction_id=([^/]+)/[^/]+\.parquet$"
    rows = rows.withColumns({"__id": F.regexp_extract("__path", folder, 2), "__date": F.regexp_extract("__path", folder, 1)}).where(~F.col("__id").startswith(ignored))
    upper = lambda df: df.where(F.col(contract.watermark).isNotNull()).agg(F.max(F.struct(*contract.cursor)).alias("w"))
    want = source.agg(F.count(F.lit(1)).alias("source_rows")).join(upper(contract.select(source)).withColumnRenamed("w", "source_top"))
    got = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*keys)).alias("keys"), F.max(F.struct(*contract.cursor)).alias("top"), F.count_if(F.col("__id") == "").alias("wrong_path"),
        F.count_if((F.col("__id") != "") & (F.col("__date") != F.date_format("_ingested_at", "yyyy-MM-dd"))).alias("wrong_date"), F.count_if(~F.col("_source_table").eqNullSafe(F.lit(contract.name))).alias("wrong_source_table"),
        F.count_if(~F.col("_ingestion_id").eqNullSafe(F.col("__id"))).alias("wrong_ingestion_id"), F.count_if(~F.col("_ingestion_method").eqNullSafe(F.lit(METHOD))).alias("wrong_method"),
        F.count_if(F.col("_ingested_at").isNull()).alias("null_ingested_at"), F.count_if(F.col("_source_updated_at").isNull()).alias("null_source_updated_at"),
        F.count_if(~F.col("_source_updated_at").eqNullSafe(F.col(contract.watermark))).alias("other_updated_at"), F.count_if(any_null(keys)).alias("null_key"),
    )
    mark = control.checkpoint()
    at = F.struct(*[F.lit(mark[c]).cast(TYPES[contract.columns[c]]).alias(c) for c in contract.cursor])
    both = got.join(want).select(
        *[c for c in got.columns if c not in ("rows", "keys", "top")], (F.col("rows") == 0).cast("long").alias("no_rows"), F.abs(F.col("keys") - F.col("source_rows")).alias("missing_keys"),
        (~F.col("top").eqNullSafe(F.col("source_top"))).cast("long").alias("top_is_not_source_upper"), (~at.eqNullSafe(F.col("source_top"))).cast("long").alias("checkpoint_is_not_source_upper"),
        F.lit(int(control.pending() is not None)).cast("long").alias("batch_pending"),
    )
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("failures")) for n in both.columns])).alias("c")).select("c.*")


def type_checks(spark: SparkSession, contract: TableContract, bronze: str) -> DataFrame:
    """(check_name, failures): files whose own types aren't those of the contract (microseconds, never nanoseconds; a column of nulls keeps its type). Footers are read where there is room."""
    files = listed(spark, f"{bronze}/{contract.name}", "*.parquet")
    return wrong_types(files, contract.bronze_schema()).select(F.concat(F.lit("type_"), "column").alias("check_name"), "failures")
