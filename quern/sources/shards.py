"""Tables of an embedded database on a cluster: a table is dealt over many SQLite files in the shared folder.

A file is written by one task, on its own disk first, and never changes afterwards, so any number of tasks read it without locks. What a task has
written counts only once a list of files, which Spark writes, names it; a task that is run again leaves a file that nobody names. Questions go to each file in
SQL, so the database picks rows and columns and adds up its own rows; Spark adds up what the files answer.

Functions go to Python workers by value, so the package need not be installed there.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalar import checked_identifier
from quern.operators.quality import QualityError
from quern.storage import Files

#: Rows of a file.
ROWS = 1_000_000
#: Rows that go to and come from a file at once.
BATCH = 10_000
#: What SQLite holds of a type: times are microseconds, dates days, both since 1970.
KINDS = {T.StringType: "TEXT", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.DoubleType: "REAL", T.TimestampType: "INTEGER", T.TimestampNTZType: "INTEGER", T.DateType: "INTEGER"}


def place_of(path: str):
    """A store and a path in it."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def plain(column: pa.Array) -> list:
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).to_pylist()
    return (column.cast(pa.int32()) if pa.types.is_date32(column.type) else column).to_pylist()


def typed(values: Sequence, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind):
        return pa.array(values, pa.int64()).cast(pa.timestamp("us", kind.tz)).cast(kind)
    return pa.array(values, pa.int32()).cast(kind) if pa.types.is_date32(kind) else pa.array(values, kind)


def saved(batches: Iterator[pa.RecordBatch], folder: str, columns: str, most: int) -> Iterator[pa.RecordBatch]:
    """Writes the rows of a task; (path, rows) of each file."""
    import os
    import sqlite3
    import tempfile

    from pyarrow import fs

    store, root = place_of(folder)
    with tempfile.TemporaryDirectory() as own:
        db, n, beside = None, 0, f"{own}/rows.sqlite"

        def closed() -> pa.RecordBatch:
            db.commit()
            db.close()
            name = f"{uuid.uuid4().hex}.sqlite"
            fs.copy_files(beside, f"{root}/{name}", source_filesystem=fs.LocalFileSystem(), destination_filesystem=store)
            os.remove(beside)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "rows": pa.array([n], pa.int64())})

        for batch in batches:
            while len(batch):
                if db is None:
                    store.create_dir(root, recursive=True)
                    db, n = sqlite3.connect(beside), 0
                    db.executescript(f"PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF; CREATE TABLE rows ({columns})")
                some, batch = batch.slice(0, most - n), batch.slice(min(len(batch), most - n))
                db.executemany(f"INSERT INTO rows VALUES ({', '.join('?' * some.num_columns)})", zip(*[plain(c) for c in some.columns]))
                n += len(some)
                if n == most:
                    yield closed()
                    db = None
        if db is not None:
            yield closed()


def answered(batches: Iterator[pa.RecordBatch], sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import os
    import sqlite3
    import tempfile

    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, place = place_of(path)
            with tempfile.TemporaryDirectory() as own:
                if not isinstance(store, fs.LocalFileSystem):
                    fs.copy_files(place, f"{own}/rows.sqlite", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
                    place = f"{own}/rows.sqlite"
                elif not os.path.exists(place):
                    raise FileNotFoundError(place)
                db = sqlite3.connect(f"file:{place.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)
                try:
                    cursor = db.execute(sql)
                    while rows := cursor.fetchmany(BATCH):
                        yield pa.RecordBatch.from_arrays([typed(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                finally:
                    db.close()


class ShardedTable:
    """A table in a folder. `current` names the load that is served."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    @property
    def pointer(self) -> str:
        return f"{self.path}/_current.json"

    def served(self) -> str:
        return json.loads(self.files.read(self.pointer))["load"]

    def write(self, rows: DataFrame, most: int = ROWS) -> str:
        """Writes a load beside the others, at most `most` rows a file; returns its name."""
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        if odd := [f.name for f in rows.schema if type(f.dataType) not in KINDS]:
            raise ValueError(f"columns of a type that the database lacks: {', '.join(odd)}")
        load = f"load-{uuid.uuid4().hex}"
        folder, columns = f"{self.path}/{load}", ", ".join(f'"{checked_identifier(f.name)}" {KINDS[type(f.dataType)]}' for f in rows.schema)
        rows.mapInArrow(lambda it: saved(it, f"{folder}/rows", columns, most), "path string, rows long").write.parquet(f"{folder}/files")
        return load

    def ask(self, sql: str, schema: str, load: str | None = None) -> DataFrame:
        """What each file of a load (the served one) answers; the table is called rows."""
        from pyspark.sql.pandas.types import to_arrow_schema

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        files = self.spark.read.schema("path string, rows long").parquet(f"{self.path}/{load or self.served()}/files")
        kind = self.spark.createDataFrame([], schema).schema
        arrow = to_arrow_schema(kind)
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return files.select("path").repartition(tasks, F.xxhash64("path")).mapInArrow(lambda it: answered(it, sql, arrow), kind)

    def count(self) -> int:
        return self.ask("SELECT count(*) FROM rows", "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def load(self, rows: DataFrame, keys: Sequence[str], fail: Callable[[str], None] = lambda step: None) -> int:
        """Writes, checks and promotes; returns the number of rows. Rows are dealt by key, so each file can tell which of its keys repeat."""
        n = rows.count()  # of files, only their footers
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-n // ROWS))
        load = self.write(rows.repartition(tasks, *keys), sys.maxsize)
        fail("check")
        self.require_keys(load, keys, n)
        fail("promote")
        self.files.write(self.pointer, json.dumps({"load": load}))
        return n

    def require_keys(self, load: str, keys: Sequence[str], rows: int) -> None:
        """As many rows as said, no null and no repeated key; the database counts."""
        cols = [f'"{checked_identifier(k)}"' for k in keys]
        null = " OR ".join(f"{c} IS NULL" for c in cols)
        groups = f"SELECT {', '.join(cols)}, COUNT(*) AS times FROM rows GROUP BY {', '.join(cols)}"
        got = self.ask(f"SELECT COALESCE(SUM(times), 0), COUNT(CASE WHEN {null} THEN 1 END), COUNT(CASE WHEN times > 1 THEN 1 END) FROM ({groups})", "n long, nulls long, repeated long", load)
        n, nulls, repeated = got.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in got.columns]).first()
        if n != rows or nulls or repeated:
            raise QualityError(f"{self.path}: rows {n} of {rows}, null keys {nulls}, repeated keys {repeated}")
