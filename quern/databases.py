"""Queries that go through a relational database: the test tables are loaded into an embedded one, then read, aggregated and replaced there.

In local mode that is Derby over JDBC. It is seen by one process only, and Spark brings no database server; so on a cluster the tables lie in an embedded
database of many files (`quern.sources.shards`), which the executors write and ask in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import views as V
from quern.catalogue import query
from quern.protocols import Crash, crash_once, folder
from quern.sources.database import Database, embedded, in_one_process
from quern.sources.shards import ShardedTable

PARTS = 6


def with_lines(spark: SparkSession, d: str) -> Database:
    db = embedded(spark, f"{folder(spark, 'database')}/db")
    db.create_schema()
    db.write(V.read(spark, d, "lineitem"), "lineitem", ["l_returnflag", "l_linestatus"])
    return db


def sharded_lines(spark: SparkSession, d: str) -> tuple[ShardedTable, str]:
    table = ShardedTable(spark, f"{folder(spark, 'database')}/lineitem")
    return table, table.write(V.read(spark, d, "lineitem"))


def schema_of(rows: DataFrame, *columns: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema)


LINE, PICKED = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate"), "l_quantity >= 45 and l_returnflag = 'R'"


@query("jdbc_scan", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def jdbc_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines in ranges of the order, each over a connection of its own; the database filters and sends five columns."""
    if not in_one_process(spark):
        table, load = sharded_lines(spark, d)
        return table.ask(f"SELECT {', '.join(LINE)} FROM rows WHERE {PICKED}", schema_of(V.read(spark, d, "lineitem"), *LINE), load)
    return with_lines(spark, d).scan("lineitem", "l_orderkey", PARTS).where(PICKED).select(*LINE)


@query("jdbc_pushdown", "SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity, min(l_shipdate) AS first_shipped, max(l_extendedprice) AS largest_price FROM lineitem WHERE l_quantity < 40 GROUP BY 1, 2")
def jdbc_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """Groups that the database makes; a row a group crosses the connection."""
    if not in_one_process(spark):
        table, load = sharded_lines(spark, d)
        kind = V.read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.lit(1).cast("long").alias("lines"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("first_shipped"), F.col("l_extendedprice").alias("largest_price"))
        sql = "SELECT l_returnflag, l_linestatus, count(*), sum(l_quantity), min(l_shipdate), max(l_extendedprice) FROM rows WHERE l_quantity < 40 GROUP BY 1, 2"
        of_files = table.ask(sql, schema_of(kind, "*"), load)  # a row a group and file
        return of_files.groupBy("l_returnflag", "l_linestatus").agg(F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"), F.min("first_shipped").alias("first_shipped"), F.max("largest_price").alias("largest_price"))
    lines = with_lines(spark, d).table("lineitem").where("l_quantity < 40")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.min("l_shipdate").alias("first_shipped"), F.max("l_extendedprice").alias("largest_price"))


@query("jdbc_promote", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'C' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate FROM orders")
def jdbc_promote(spark: SparkSession, d: str) -> DataFrame:
    """Orders of yesterday are served; a load of today's crashes between load and promotion, which the served table doesn't show; the next one takes its place."""
    keys, columns, orders = ["o_orderkey"], ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), V.read(spark, d, "orders")
    today = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "C").otherwise(F.col("o_orderstatus")))
    if in_one_process(spark):
        db = embedded(spark, f"{folder(spark, 'database')}/db")
        load, count = (lambda rows, **fail: db.load(rows, "orders", keys, **fail)), lambda: db.table("orders").count()
    else:
        table = ShardedTable(spark, f"{folder(spark, 'database')}/orders")
        load, count = (lambda rows, **fail: table.load(rows, keys, **fail)), table.count
    before = load(orders.where("o_orderkey % 7 <> 0"))
    stop = crash_once("promote")
    stop("promote")
    try:
        load(today, fail=stop)
        raise RuntimeError("the load should have crashed")
    except Crash:
        if count() != before:
            raise RuntimeError("a load that isn't promoted shows") from None
    load(today)
    if in_one_process(spark):
        return db.scan("orders", "o_orderkey", PARTS).select(*columns)
    return table.ask(f"SELECT {', '.join(columns)} FROM rows", schema_of(orders, *columns))
