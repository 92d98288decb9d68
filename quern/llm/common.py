"""What the corpus operators share: input tables, the shared work folder, written intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that are sent to a Python worker at once.
ROWS, BATCH_BYTES = 1000, "16m"
_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of an input folder, read by Spark alone."""
    ship_package(spark)
    return dealt_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dealt_out(rows: DataFrame) -> DataFrame:
    """`rows`, dealt to all cores if they lie in fewer row groups than there are cores.

    Row groups are what a scan can be split into, so a small table in one of them would keep one core busy. They are counted from
    footers, and only where the scan has few splits; a table that keeps all cores busy is left as it is.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() > 4 * cores:
        return rows
    busy = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows.repartition(cores) if busy < cores else rows


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that it need not be installed there.

    Two settings of the session change for everything that runs in it: rows go to Python workers in batches of at most `ROWS` and
    `BATCH_BYTES` (or one row), whichever is reached first, unless the session says otherwise. Spark's own limit of 10,000 rows is meant for numbers, not for
    whole texts.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parents[2]
        _SHIPPED.add(app)
        place = tempfile.mkdtemp(prefix="quern-package-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        path = f"{place}/quern.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((root / "quern").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(path)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`).

    Where it is unset and everything runs in one process (tests), a temporary folder takes its place and is removed at exit.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "local" not in _OWN:
        _OWN["local"] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _OWN["local"], ignore_errors=True)
    return _OWN["local"]


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: its lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)  # what nobody drops before goes with the driver
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def joined_by_size(rows: DataFrame, small: DataFrame, on: str, count_col: str, many: int) -> DataFrame:
    """Inner join with `small` (one row for each key): keys with more than `many` rows by broadcast, the others by shuffle.

    There are fewer than all rows / many of the former, so `many` bounds what is broadcast.
    """
    often = F.broadcast(small.where(F.col(count_col) > many))
    rest = rows.join(often.select(on), on, "left_anti").join(small.where(F.col(count_col) <= many), on)
    return rows.join(often, on).unionByName(rest)


def text_or_empty(name: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


#: Bits of a filter for each key, and the most bits of one that is broadcast (64 MB).
BITS_A_KEY, MOST_BITS = 16, 1 << 29
#: Keys with more than a part of this many of all rows are few enough to be broadcast.
PARTS = 10_000


@dataclass
class Filter:
    """Bitmaps (bucket, bits) of the hashes of some keys; None where they would be too large to broadcast."""

    bitmaps: DataFrame | None
    size: int


def filter_of(keys: DataFrame, key: str, n: int, most_bits: int = MOST_BITS) -> Filter:
    """A filter of `n` keys, sized by their number."""
    size = max(1 << 15, 1 << max(0, n * BITS_A_KEY - 1).bit_length())
    if size > most_bits:
        return Filter(None, size)
    spot = F.pmod(F.xxhash64(key), F.lit(size))
    buckets = keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__bucket"))
    return Filter(written(buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits")), "filter"), size)


def may_have(rows: DataFrame, key: str, known: Filter, name: str = "__may") -> DataFrame:
    """`rows` with `name`: false only where the filter's keys have no such key; true everywhere without bitmaps. Other columns stay, whatever they are called."""
    if known.bitmaps is None:
        return rows.withColumn(name, F.lit(True))
    bucket, at, bits = (free_name(rows, x) for x in ("__bucket", "__at", "__bits"))
    spot = F.pmod(F.xxhash64(key), F.lit(known.size))
    bitmaps = known.bitmaps.select(F.col("__bucket").alias(bucket), F.col("__bits").alias(bits))
    rows = rows.withColumns({bucket: F.bitmap_bucket_number(spot), at: F.bitmap_bit_position(spot)})
    byte = F.expr(f"cast(conv(hex(substring(`{bits}`, cast(`{at}` div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr(f"shiftleft(1, cast(`{at}` % 8 as int))")
    found = rows.join(F.broadcast(bitmaps), bucket, "left")
    return found.withColumn(name, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop(bucket, at, bits)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that `written` has made since it had made `since` tables, but for the last `keep`. Frames that read them are of no use afterwards."""
    until = len(_MADE) - keep
    for path in _MADE[since:until]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    del _MADE[since:until]


def made() -> int:
    """How many tables `written` has made and that are still there."""
    return len(_MADE)


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "n") -> DataFrame:
    """`rows` with their place in `order`, from 0. The order has to tell all rows apart.

    Rows are dealt by ranges of the order and numbered in their tasks; the ranges' starts (a row for each task) are all that is
    added up. `rows` is read twice, so it should be narrow and written.
    """
    tag, part, start = (free_name(rows, x) for x in ("__tag", "__part", "__start"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(tag, F.monotonically_increasing_id())
    dealt = written(dealt.withColumn(part, F.shiftright(tag, 33)), "numbered")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(start))
    starts = counts.select(part, F.coalesce(F.sum(start).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start))
    within = F.col(tag).bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), part).withColumn(name, F.col(start) + within).drop(tag, part, start)
