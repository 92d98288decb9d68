"""Tables as versioned Parquet snapshots behind a pointer: overwrite, append, merge, staged loads with atomic promotion.

A version is a folder of its own, so a table can be read while its next version is written. The pointer file names the
current version; it is replaced in one rename. A crash before that leaves the old version in place.
All file operations go through the Hadoop file system of the path, so they work on any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.operators import versions as R
from quern.operators.quality import QualityError


class Files:
    """Small files in the store of a path."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def fs(self, p: str):
        return self.path(p).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.fs(p).exists(self.path(p))

    def read(self, p: str) -> str:
        stream = self.fs(p).open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, p: str, text: str) -> None:
        """The whole file or none of it: written beside, then renamed over."""
        temp, fs = f"{p}.{uuid.uuid4().hex}.tmp", self.fs(p)
        out = fs.create(self.path(temp), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(p).toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(self.path(temp)), context.makeQualified(self.path(p)), options)

    @property
    def gateway(self):
        from pyspark import SparkContext

        return SparkContext._gateway

    def delete(self, p: str) -> None:
        self.fs(p).delete(self.path(p), True)

    def size(self, p: str) -> int:
        return self.fs(p).getFileStatus(self.path(p)).getLen()

    def copy(self, source: str, target: str) -> None:
        """The whole file or none of it."""
        temp = f"{target}.{uuid.uuid4().hex}.tmp"
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs(source), self.path(source), self.fs(target), self.path(temp), False, self.conf)
        self.fs(target).rename(self.path(temp), self.path(target))

    def move(self, source: str, target: str) -> None:
        """Takes the place of what is there; within one store."""
        fs, to = self.fs(target), self.path(target)
        fs.delete(to, True)
        fs.mkdirs(to.getParent())
        if not fs.rename(self.path(source), to):
            raise OSError(f"{source} can't take the name {target}")

    def names(self, p: str) -> list[str]:
        if not self.exists(p):
            return []
        return sorted(s.getPath().getName() for s in self.fs(p).listStatus(self.path(p)))

    def walk(self, p: str, name: str) -> list[str]:
        """Folders below p that have a file of this name, sorted."""
        if not self.exists(p):
            return []
        out, it = [], self.fs(p).listFiles(self.path(p), True)
        while it.hasNext():
            f = it.next().getPath()
            if f.getName() == name:
                out.append(f.getParent().toString())
        return sorted(out)

    def walk_files(self, p: str, ending: str) -> list[str]:
        """Files below p whose name ends so, sorted."""
        out, it = [], self.fs(p).listFiles(self.path(p), True)
        while it.hasNext():
            f = it.next().getPath().toString()
            if f.endswith(ending):
                out.append(f)
        return sorted(out)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    @property
    def pointer(self) -> str:
        return f"{self.path}/_current.json"

    def exists(self) -> bool:
        return self.files.exists(self.pointer)

    def state(self) -> dict:
        return json.loads(self.files.read(self.pointer))

    def version(self) -> int:
        return self.state()["version"] if self.exists() else 0

    def read(self) -> DataFrame:
        state = self.state()
        return self.of_parts(state["parts"], state["schema"])

    def of_parts(self, parts: Sequence[str], schema: str) -> DataFrame:
        """Columns are those in the files; folder names become none. Files hold one value of a partition column, so their statistics prune."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*[f"{self.path}/{p}" for p in parts])

    def staged(self, df: DataFrame, partition_by: Sequence[str] = ()) -> str:
        part = f"data-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", 500_000).partitionBy(*partition_by).parquet(f"{self.path}/{part}")
        return part

    def point(self, parts: Sequence[str], schema: str, **more: object) -> None:
        self.files.write(self.pointer, json.dumps({"version": self.version() + 1, "parts": list(parts), "schema": schema} | more))

    def staged_buckets(self, df: DataFrame, keys: Sequence[str], buckets: int) -> list[str]:
        """Parts by bucket of the key, each a folder of its own."""
        rows = df.withColumn(BUCKET, bucket_of(keys, buckets))
        part = self.staged(rows.repartition(BUCKET), [BUCKET])
        return [f"{part}/{n}" for n in self.files.names(f"{self.path}/{part}") if n.startswith(f"{BUCKET}=")]

    def overwrite(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None, measures: Mapping[str, Column] | None = None, require: Callable[[Mapping], None] | None = None) -> dict:
        """A new version, which only becomes current if its checks pass.

        measures: aggregates that are taken while the rows are written; `require` looks at them, and the pointer keeps them. check:
        looks at what was written.
        """
        schema, seen = schema_of(df), Observation() if measures else None
        part = self.staged(df.observe(seen, *[c.alias(n) for n, c in measures.items()]) if measures else df)
        try:
            got = dict(seen.get) if measures else {}
            if require:
                require(got)
            if check:
                check(self.of_parts([part], schema))
        except Exception:
            self.files.delete(f"{self.path}/{part}")
            raise
        self.point([part], schema, **({"measures": {k: str(v) for k, v in got.items()}} if got else {}))
        return got

    def append(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None, partition_by: Sequence[str] = ()) -> None:
        """Another part; with a check it only becomes current if that passes on what was written. partition_by: columns that are kept in the files too."""
        if check or partition_by:
            return self.append_checked(df, check, partition_by)
        if not self.exists():
            return self.overwrite(df)
        state = self.state()
        have = self.spark.createDataFrame([], state["schema"]).columns
        if "buckets" in state:
            raise ValueError(f"{self.path} is dealt by key; merge into it")
        self.point([*state["parts"], self.staged(df.select(*have))], state["schema"])
        return None

    def append_checked(self, df: DataFrame, check: Callable[[DataFrame], None] | None, partition_by: Sequence[str]) -> None:
        state = self.state() if self.exists() else {"parts": [], "schema": schema_of(df)}
        have = self.spark.createDataFrame([], state["schema"]).columns
        rows = df.select(*have).withColumns({f"{PARTITION}{c}": F.col(c) for c in partition_by})
        part = self.staged(rows, [f"{PARTITION}{c}" for c in partition_by])
        try:
            if check:
                check(self.of_parts([part], state["schema"]))
        except Exception:
            self.files.delete(f"{self.path}/{part}")
            raise
        self.point([*state["parts"], part], state["schema"])

    def append_measured(self, df: DataFrame, measures: Mapping[str, Column], require: Callable[[Mapping], None], partition_by: Sequence[str] = ()) -> dict:
        """Another part, which only becomes current if `require` agrees with aggregates that are taken while it is written."""
        state = self.state() if self.exists() else {"parts": [], "schema": schema_of(df)}
        have, seen = self.spark.createDataFrame([], state["schema"]).columns, Observation()
        rows = df.select(*have).observe(seen, *[c.alias(n) for n, c in measures.items()])
        part = self.staged(rows.withColumns({f"{PARTITION}{c}": F.col(c) for c in partition_by}), [f"{PARTITION}{c}" for c in partition_by])
        try:
            got = dict(seen.get)
            require(got)
        except Exception:
            self.files.delete(f"{self.path}/{part}")
            raise
        self.point([*state["parts"], part], state["schema"])
        return got

    def merge(self, source: DataFrame, keys: Sequence[str], watermark: str = "updated_at", ingested: str = "_ingested_at", buckets: int = 1, check: Callable[[DataFrame], None] | None = None) -> int:
        """Applies what is new or newer; returns the number of rows applied, 0 leaving the version as it is.

        The first merge deals the table out by `buckets` of the key. Later ones read and write only buckets that the source meets.
        check: looks at the buckets that were written before they become current.
        """
        if not self.exists():
            parts, schema = self.staged_buckets(source, keys, buckets), schema_of(source)
            if check and parts:
                check(self.of_parts(parts, schema))
            self.point(parts, schema, buckets=buckets, keys=list(keys))
            return self.read().count()
        state = self.state()
        dealt = state.get("keys") == list(keys)  # else the whole table is read, and dealt out when something changes
        buckets = state["buckets"] if dealt else buckets
        met_by = lambda df: {r[0] for r in df.select(bucket_of(keys, buckets)).distinct().collect()}  # noqa: E731  (at most as many as buckets)
        applied = SnapshotTable(self.spark, f"{self.path}/_changes-{uuid.uuid4().hex}")
        try:
            applied.overwrite(R.changes(source, self.read_buckets(met_by(source)) if dealt else self.read(), keys, watermark, ingested))
            n = applied.read().count()
            if not applied.read().groupBy(*keys).count().where("count > 1").isEmpty():
                raise QualityError("several source rows for a key")
            if n:
                met = met_by(applied.read()) if dealt else set(range(buckets))
                old = self.read_buckets(met) if dealt else self.read()
                untouched = [p for p in state["parts"] if bucket_in(p) not in met] if dealt else []
                new = self.staged_buckets(R.merged(old, applied.read(), keys), keys, buckets)
                if check:
                    check(self.of_parts(new, state["schema"]))
                self.point(untouched + new, state["schema"], buckets=buckets, keys=list(keys))
            return n
        finally:
            self.files.delete(applied.path)

    def read_buckets(self, buckets: set[int]) -> DataFrame:
        state = self.state()
        parts = [p for p in state["parts"] if bucket_in(p) in buckets]
        return self.of_parts(parts, state["schema"]) if parts else self.spark.createDataFrame([], state["schema"])

    def insert_new(self, source: DataFrame, keys: Sequence[str]) -> None:
        """Appends the rows whose key is not there yet."""
        if not self.exists():
            return self.overwrite(source.dropDuplicates(list(keys)))
        if "buckets" in self.state():
            self.merge(R.insert_new(self.read(), source, keys), keys)
            return None
        return self.append(R.insert_new(self.read(), source, keys))

    def vacuum(self) -> int:
        """Removes the folders of older versions; not while something reads them."""
        keep = {p.split("/")[0] for p in self.state()["parts"]}
        old = [n for n in self.files.names(self.path) if n.startswith("data-") and n not in keep]
        for n in old:
            self.files.delete(f"{self.path}/{n}")
        return len(old)


BUCKET, PARTITION = "__bucket", "part_"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def bucket_in(part: str) -> int | None:
    return int(part.rsplit("=", 1)[1]) if f"/{BUCKET}=" in part else None


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def digests(columns: Sequence[str]) -> dict[str, Column]:
    """Aggregates over all rows that don't depend on their order: how many there are, and sum and parity of two hashes of each.

    Nulls are hashed by their place, so that a value can't move from one column to another unseen.
    """
    cols = [F.col(f"`{c}`") for c in sorted(columns)]
    holes = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    one, two = F.xxhash64(holes, *cols), F.xxhash64(F.lit(1), *reversed(cols), holes)
    return {"rows": F.count(F.lit(1)), "digest_sum": F.sum(one.cast("decimal(38,0)")), "digest_xor": F.bit_xor(two)}


def fingerprint(df: DataFrame) -> dict[str, str]:
    """The digests of a frame, in one aggregate: a row a task crosses the network."""
    return {k: str(v) for k, v in df.agg(*[c.alias(n) for n, c in digests(df.columns).items()]).first().asDict().items()}


def load_staging(source: DataFrame, target: SnapshotTable, keys: Sequence[str], skip_same: bool = False) -> str:
    """Loads a table for serving: as many rows as the source, no null or repeated key, then promotion in one step.

    Rows, null keys and the fingerprint are taken while the rows are written; what was written is read once, for repeated keys.
    Returns LOADED, or NO_OP where the source has the very rows that are served (`skip_same`); equal counts alone are none.
    """
    if skip_same and same_as_served(source, target):
        return "NO_OP"
    seen: dict = {}

    def require(got: Mapping) -> None:
        seen.update(got)
        if got["null_keys"]:
            raise QualityError(f"null keys {got['null_keys']}")

    def check(written: DataFrame) -> None:
        times = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        rows, again = times.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
        if rows != seen["rows"] or again:
            raise QualityError(f"rows {rows} of {seen['rows']}, repeated keys {again}")

    target.overwrite(source, check, {**digests(source.columns), "null_keys": F.count_if(R.any_null(keys))}, require)
    return "LOADED"


def same_as_served(source: DataFrame, target: SnapshotTable) -> bool:
    """Whether the source's rows are those that the target has; its fingerprint was kept when it was loaded, or else is taken now."""
    if not target.exists():
        return False
    have = fingerprint(source)
    served = target.state().get("measures") or (fingerprint(target.read()) if set(target.read().columns) == set(source.columns) else {})
    return {k: served.get(k) for k in have} == have
