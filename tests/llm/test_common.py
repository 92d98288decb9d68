import pytest
from pyspark.sql import functions as F

from quern.llm.common import dealt_out, numbered, written
from quern.llm.units import by_size


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_numbers_have_no_gap(spark, n):
    rows = written(spark.range(n).select((F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("tag")).repartition(7), "rows")
    got = numbered(rows, [F.col("k").desc(), F.col("tag")], "place").collect()
    assert [(r["k"], r["tag"]) for r in sorted(got, key=lambda r: r["place"])] == sorted(((i * 7919 % 1000, i) for i in range(n)), key=lambda x: (-x[0], x[1]))
    assert sorted(r["place"] for r in got) == list(range(n))


def test_one_value_is_numbered_by_many_tasks(spark):
    rows = written(spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("tag")), "rows")
    assert sorted(r["n"] for r in numbered(rows, [F.col("k"), F.col("tag")]).collect()) == list(range(20_000))
    parts = rows.repartitionByRange(8, "k", "tag").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 6000


def test_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(200).write.parquet(f"{tmp_path}/many")
    one, many = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("one", "many"))
    assert dealt_out(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and dealt_out(one).count() == 1000
    assert dealt_out(many) is many
    assert dealt_out(spark.range(0)).count() == 0


def test_slices_by_size():
    assert [list(range(10))[s] for s in by_size(["aaa", "b", "cc", "", "d" * 9, "e"], 4)] == [[0, 1], [2, 3], [4], [5]]
    assert list(by_size([])) == []


def test_texts_go_to_workers_by_bytes(spark):
    from quern.llm.common import ship_package

    ship_package(spark)
    texts = spark.range(60).coalesce(1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))

    def sizes(frames):
        for pdf in frames:
            yield pdf.assign(n=len(pdf)).head(1)[["n"]]

    assert max(r["n"] for r in texts.mapInPandas(sizes, "n long").collect()) <= 17
