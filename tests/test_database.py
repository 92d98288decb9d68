import pytest
from pyspark.sql import functions as F

from quern.databases import with_lines
from quern.operators.quality import QualityError
from quern.sources.database import Database, embedded


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return with_lines(spark, sf_dir)


def test_filters_and_columns_are_pushed(lines):
    df = lines.scan("lineitem", "l_orderkey", 5).where("l_quantity >= 45").select("l_orderkey")
    assert df.rdd.getNumPartitions() == 5
    assert "l_quantity >= 45.0" in plan(df).split("PushedFilters")[1] and "l_shipdate" not in plan(df)


def test_aggregates_are_pushed(lines):
    df = lines.table("lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    assert "PushedAggregates: [COUNT(*), SUM(l_quantity)]" in plan(df) and "PushedGroupByExpressions: [l_returnflag]" in plan(df)
    assert "HashAggregate" not in plan(df) and "Exchange" not in plan(df)  # rows of the result are all that come
    assert sum(r["n"] for r in df.collect()) == lines.table("lineitem").count()


def test_parts_hold_every_row_once(spark, tmp_path):
    db = embedded(spark, f"{tmp_path}/db")
    db.create_schema()
    for values in ([None, 1, 1, 2, 50, 1000], [None, None], [], [7, 7, 7]):
        db.write(spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i int"), "things")
        for parts in (1, 2, 4):
            assert sorted(r["i"] for r in db.scan("things", "v", parts).collect()) == list(range(len(values)))
    db.write(spark.sql("SELECT date_add(date'2020-01-01', cast(id AS int)) AS day, id FROM range(50)"), "days")
    assert db.scan("days", "day", 4).rdd.getNumPartitions() == 4 and db.scan("days", "day", 4).count() == 50
    with pytest.raises(ValueError, match="no ranges"):
        db.write(spark.createDataFrame([("a",)], "s string"), "words", ["s"])
        db.scan("words", "s", 3)


class Crash(Exception):
    pass


def crash_at(step):
    def fail(s):
        if s == step:
            raise Crash(s)

    return fail


@pytest.mark.parametrize("in_place", [False, True])
def test_a_load_shows_whole_or_not_at_all(spark, tmp_path, in_place):
    db = embedded(spark, f"{tmp_path}/db")
    rows = lambda n, word: spark.range(n).select(F.col("id").alias("key"), F.lit(word).alias("word"))
    seen = lambda: (db.table("things").count(), db.table("things").first()["word"])
    assert db.load(rows(5, "old"), "things", ["key"]) == 5 and seen() == (5, "old")
    for step in ("check", "promote"):
        with pytest.raises(Crash):
            db.load(rows(9, "new"), "things", ["key"], in_place=in_place, fail=crash_at(step))
        assert seen() == (5, "old")
    for bad in (rows(3, "bad").union(rows(1, "bad")), rows(3, "bad").union(spark.createDataFrame([(None, "bad")], "key long, word string"))):
        with pytest.raises(QualityError):
            db.load(bad, "things", ["key"], in_place=in_place)
        assert seen() == (5, "old")
    assert db.load(rows(9, "new"), "things", ["key"], in_place=in_place) == 9 and seen() == (9, "new")
    assert not db.exists("load_things") and not db.exists("things_retired")
    with pytest.raises(Crash):
        db.load(rows(2, "newest"), "things", ["key"], in_place=in_place, fail=crash_at("verify"))
    assert seen() == (2, "newest")  # the promotion was over
    assert db.load(rows(0, ""), "things", ["key"]) == 0 and db.table("things").count() == 0
    named = rows(3, "w").withColumn("key", F.concat(F.lit("k"), "key"))
    assert db.load(named, "named", ["key"], ["word"]) == 3 and db.table("named").groupBy("word").count().first()[1] == 3


def test_a_failed_promotion_is_rolled_back(spark, tmp_path):
    db = embedded(spark, f"{tmp_path}/db")
    db.load(spark.range(4).withColumn("more", F.lit(1)), "things", ["id"])
    db.write(spark.range(6), "load_things")
    with pytest.raises(Exception, match="more"):
        db.promote("load_things", "things", ["id", "more"], in_place=True)
    assert db.table("things").count() == 4 and db.exists("load_things")


def test_types_come_back(spark, tmp_path):
    db = embedded(spark, f"{tmp_path}/db")
    rows = spark.sql("SELECT 'é' || repeat('x', 5000) AS text, cast(1.25 AS decimal(10,2)) AS money, timestamp_ntz'2020-01-02 03:04:05.123456' AS at, date'2020-01-02' AS day, 3 AS n, cast(null AS string) AS none")
    db.load(rows, "things", ["n"])
    assert db.table("things").first() == rows.first() and dict(db.table("things").dtypes) == dict(rows.dtypes)


def test_names_and_places(spark, tmp_path):
    db = Database(spark, "jdbc:postgresql://host/db", "staging")
    assert db.named("orders") == '"staging"."orders"' and db.rename("load_orders", "orders") == 'ALTER TABLE "staging"."load_orders" RENAME TO "orders"'
    with pytest.raises(ValueError):
        db.named('x"; DROP TABLE y')
