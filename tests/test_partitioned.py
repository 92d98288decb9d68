from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators.quality import QualityError
from quern.operators.versions import merge_newer
from quern.partitioned import PART, PartitionedTable, by_month, by_range
from quern.storage import SnapshotTable, fingerprint, load_staging

T0 = datetime(2026, 1, 1)


def rows(spark, n, word="a", day=1):
    """`n` orders over three years, each in the month of its own date."""
    return spark.range(n).select("id", F.lit(word).alias("word"), F.expr("timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(cast(id % 1080 AS int))").alias("at"), F.lit(T0 + timedelta(days=day)).cast("timestamp_ntz").alias("updated_at"), F.lit(T0).cast("timestamp_ntz").alias("_ingested_at"))


def table(spark, place, part=None):
    return PartitionedTable(spark, str(place), rows(spark, 1).schema, ["id"], by_month("at") if part is None else part)


def files(place):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(place).rglob("*.parquet")}


def test_a_merge_reads_and_writes_only_its_partitions(spark, tmp_path):
    t, place = table(spark, tmp_path / "t"), tmp_path / "t"
    assert t.merge(rows(spark, 20_000)).applied == 20_000
    before = files(place)
    scattered = rows(spark, 20_000, "b", 2).where("at >= '2024-05-01' and at < '2024-07-15'").orderBy(F.rand(1)).limit(1000)
    scattered = spark.createDataFrame(scattered.collect(), scattered.schema)
    met = {f"{PART}=2024-05", f"{PART}=2024-06", f"{PART}=2024-07"}
    lost = [p for p in before if p.parent.name not in met]
    kept = {p: p.read_bytes() for p in lost}
    for p in lost:  # nothing of the other partitions can be read
        p.write_bytes(b"no parquet")
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    got = t.merge(scattered)
    assert got.applied == 1000 and {f"{PART}={x}" for x in got.partitions} <= met and got.written < 0.1 * 20_000
    after = files(place)
    assert sum(before[p][1] for p in before if p not in lost) < 0.1 * sum(s for _, s in before.values())
    assert all(p in after for p in lost) and not any(p in after for p in before if p not in lost)
    for p, content in kept.items():
        p.write_bytes(content)
    assert {(r["word"], r["n"]) for r in t.read().groupBy("word").agg(F.count("*").alias("n")).collect()} == {("a", 19_000), ("b", 1000)}
    assert t.merge(scattered).applied == 0 and files(place).keys() == after.keys()


def test_partitions_are_pruned(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(rows(spark, 500))
    plan = t.of(["2024-05"])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({PART}" in plan and "2024-05" in plan


@pytest.mark.parametrize("part", [lambda: by_month("at"), lambda: by_range("id", 7)])
def test_equals_a_merge_of_whole_tables(spark, tmp_path, part):
    t, first = table(spark, tmp_path / "t", part()), rows(spark, 60).withColumn("at", F.when(F.col("id") % 5 > 0, F.col("at")))
    t.merge(first.where("id < 40"))
    change = first.withColumns({"word": F.lit("new"), "updated_at": F.when(F.col("id") % 3 == 0, F.col("updated_at")).when(F.col("id") % 3 == 1, F.lit(T0 + timedelta(days=9)).cast("timestamp_ntz"))})
    want = merge_newer(first.where("id < 40"), change, ["id"])
    assert t.merge(change).applied > 0
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(t.read()) == key(want.select(*t.read().columns))


def test_refused(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(rows(spark, 50))
    before = files(tmp_path / "t")
    two = rows(spark, 3, "x", 5)
    for bad in (two.union(two), two.withColumn("id", F.when(F.col("id") > 0, F.col("id")))):
        with pytest.raises(QualityError):
            t.merge(bad)
    moved = two.withColumn("at", F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz"))
    with pytest.raises(QualityError, match="moved"):
        t.merge(moved, check_moves=True)
    assert files(tmp_path / "t") == before and t.merge(rows(spark, 0)).applied == 0
    assert t.merge(two, check_moves=True).applied == 3


def test_empty(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0 and t.merge(rows(spark, 0)).applied == 0 and not t.exists()


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "x"), (2, None, "x")], "k int, a string, b string")
    same = lambda x, y: fingerprint(x) == fingerprint(y)
    assert same(a, a.orderBy(F.desc("k")).repartition(3)) and same(a, a.select("b", "k", "a"))
    assert not same(a, a.limit(2)) and not same(a, a.select("k", F.col("b").alias("a"), F.col("a").alias("b")))
    assert not same(a, a.withColumn("a", F.coalesce("a", F.lit(""))))
    two = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, "x")], a.schema)
    assert not same(a, two)  # as many rows and the same values
    assert same(a.limit(0), a.limit(0)) and not same(a.limit(0), a)


def jobs_of(spark, group, f):
    spark.sparkContext.setJobGroup(group, "")
    try:
        f()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_equal_counts_are_no_reason_not_to_load(spark, tmp_path):
    a = spark.range(100).select("id", F.lit("a").alias("word"))
    b = a.withColumn("word", F.when(F.col("id") == 57, "b").otherwise("a"))
    target = SnapshotTable(spark, f"{tmp_path}/t")
    assert [load_staging(x, target, ["id"], skip_same=True) for x in (a, a, b, b)] == ["LOADED", "NO_OP", "LOADED", "NO_OP"]
    assert target.read().where("word = 'b'").count() == 1


def test_a_load_reads_its_source_once(spark, tmp_path):
    """A job writes and counts; what was written is grouped by key: with adaptive execution a job for its exchange and one for the result."""
    spark.range(1000).write.parquet(f"{tmp_path}/source")
    source, target = spark.read.parquet(f"{tmp_path}/source"), SnapshotTable(spark, f"{tmp_path}/t")
    assert jobs_of(spark, "load", lambda: load_staging(source, target, ["id"])) <= 4
    assert target.state()["measures"]["rows"] == "1000" and target.read().count() == 1000
