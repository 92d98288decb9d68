"""Shapes the test tables (orders, lineitem, events, ...) like the domain's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.versions import latest

# Warehouses with city and region, in the order of the split below.
WAREHOUSES = (("WH_HCM", "Ho Chi Minh", "SOUTH"), ("WH_HN", "Ha Noi", "NORTH"), ("WH_DN", "Da Nang", "CENTRAL"), ("WH_CT", "Can Tho", "SOUTH"), ("WH_HP", "Hai Phong", "NORTH"))
TRANSLATED = ("ECONOMY", "STANDARD", "PROMO")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def warehouse_of(key: Column) -> Column:
    """30, 25, 20, 15 and 10 percent of the keys."""
    k = key % 20
    return F.when(k < 6, "WH_HCM").when(k < 11, "WH_HN").when(k < 15, "WH_DN").when(k < 18, "WH_CT").otherwise("WH_HP")


def item_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their versions: a line's key repeats in the test data."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("price"), F.col("l_tax").cast("decimal(10,2)").alias("freight_value"),
        F.when(F.col("l_partkey") % 50 != 0, warehouse_of(F.col("l_suppkey"))).alias("warehouse_id"), F.col("l_quantity").cast("int").alias("quantity"), F.col("l_returnflag").alias("return_flag"),
        F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"),
    )


#: Lines that a task sorts or joins at most, as far as orders are of like size.
TASK_LINES = 250_000


def dealt_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of lines, dealt by order: into the session's number of partitions, or more, so that a task's rows don't grow with the table. The rows are counted from footers."""
    v, parts = item_versions(spark, sf_dir), -(-read(spark, sf_dir, "lineitem").count() // TASK_LINES)
    return v.repartition(parts, "order_id") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else v.repartition("order_id")


ITEM_KEY = ("order_id", "order_item_id")
ITEM_ORDER = ("updated_at", "product_id", "seller_id", "price", "quantity", "freight_value", "return_flag")


def stg_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest version of each line; dealt by order so that the models on orders need no other shuffle of lines."""
    return latest(dealt_by_order(spark, sf_dir), ITEM_KEY, ITEM_ORDER)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each line with the first and last shipping date of all its versions, in one pass over the lines.

    The rows are dealt by order, so that what follows for each order needs no shuffle.
    """
    v = dealt_by_order(spark, sf_dir)
    rest = [c for c in v.columns if c not in (*ITEM_KEY, *ITEM_ORDER)]
    best = F.max(F.struct(*ITEM_ORDER, *rest)).alias("l")
    return v.groupBy(*ITEM_KEY).agg(best, F.min("shipping_limit_date").alias("first_ship"), F.max("shipping_limit_date").alias("last_ship")).select(*ITEM_KEY, "l.*", "first_ship", "last_ship")


def order_measures(lines: DataFrame) -> DataFrame:
    """Measures of items and payments and shipping dates of each order; a line is a payment too."""
    from quern.plans.marts import item_measures, payment_measures

    both = lines.withColumns({"payment_value": F.col("price"), "payment_installments": F.col("order_item_id"), "payment_type": F.col("return_flag")})
    return both.groupBy("order_id").agg(*item_measures(), *payment_measures(), F.min("first_ship").alias("first_ship"), F.max("last_ship").alias("last_ship"))


def stg_order_payments(items: DataFrame) -> DataFrame:
    return items.select(
        "order_id", F.col("order_item_id").alias("payment_sequential"), F.col("return_flag").alias("payment_type"), F.col("order_item_id").alias("payment_installments"), F.col("price").alias("payment_value"), "created_at", "updated_at"
    )


def stg_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
    return orders_with(spark, sf_dir, shipped).select(*ORDER_COLUMNS)


ORDER_COLUMNS = (
    "order_id", "customer_id", "warehouse_id", "order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    "source_system", "created_at", "updated_at",
)


def orders_with(spark: SparkSession, sf_dir: str, shipped: DataFrame) -> DataFrame:
    """Orders with what is known of each from `shipped`: (order_id, first_ship, last_ship, ...)."""
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "order_id")
    bought, status = F.col("o_orderdate"), F.col("o_orderstatus")
    more = [c for c in shipped.columns if c not in ("order_id", "first_ship", "last_ship")]
    return o.join(shipped, "order_id", "left").select(
        "order_id", F.col("o_custkey").alias("customer_id"), warehouse_of(F.col("order_id")).alias("warehouse_id"), status.alias("order_status"),
        bought.alias("order_purchase_timestamp"), F.when(status != "P", bought + F.expr("interval 1 hour")).alias("order_approved_at"),
        F.when(status == "F", F.col("first_ship")).alias("order_delivered_carrier_date"), F.when(status == "F", F.col("last_ship")).alias("order_delivered_customer_date"),
        (bought + F.expr("interval 30 days")).alias("order_estimated_delivery_date"), F.lit("seed").alias("source_system"), bought.alias("created_at"), bought.alias("updated_at"), *more,
    )


def stg_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review for each first line of an order; a review may name several orders, and lines repeat."""
    li = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    return li.select((F.col("l_orderkey") % 5000).alias("review_id"), F.col("l_orderkey").alias("order_id"), (F.col("l_partkey") % 5 + 1).cast("int").alias("review_score"))


def stg_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    place = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))
    c = read(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    at = F.lit("1995-01-01").cast("timestamp_ntz")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_unique_id"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"), F.col("n_name").alias("customer_city"), F.col("r_name").alias("customer_state"), at.alias("created_at"), at.alias("updated_at"))


def stg_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    s = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    at = F.lit("1995-01-01").cast("timestamp_ntz")
    return s.select(F.col("s_suppkey").alias("seller_id"), F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"), F.col("n_name").alias("seller_city"), F.substring("n_name", 1, 2).alias("seller_state"), at.alias("created_at"), at.alias("updated_at"))


def stg_warehouses(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    at = F.lit("1995-01-01").cast("timestamp_ntz")
    return spark.createDataFrame(WAREHOUSES, "warehouse_id string, warehouse_city string, warehouse_region string").select("*", at.alias("created_at"), at.alias("updated_at"))


def stg_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1995-01-01").cast("timestamp_ntz")
    size = F.col("p_size").cast("decimal(10,2)")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.nullif(F.split_part(F.col("p_type"), F.lit(" "), F.lit(1)), F.lit("")).alias("product_category_name"), F.length("p_name").alias("product_name_lenght"), F.length("p_type").alias("product_description_lenght"),
        (F.col("p_partkey") % 7).cast("int").alias("product_photos_qty"), size.alias("product_weight_g"), size.alias("product_length_cm"), size.alias("product_height_cm"), F.lit(None).cast("decimal(10,2)").alias("product_width_cm"), at.alias("created_at"), at.alias("updated_at"),
    )


def stg_translation(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame([(t, t.lower()) for t in TRANSLATED], "product_category_name string, product_category_name_english string")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), ts.alias("event_timestamp"), F.to_date(ts).alias("event_date"), F.hour(ts).alias("event_hour"), F.get_json_object("props", "$.k").try_cast("long").alias("item_id"), F.col("event_type").alias("category")
    )


SOURCES = {
    "orders": stg_orders, "order_items": stg_order_items, "customers": stg_customers, "sellers": stg_sellers, "warehouses": stg_warehouses, "products": stg_products,
    "product_category_name_translation": stg_translation, "clicks": clicks,
}


def source(name: str):
    """A source by name, as a function of (spark, sf_dir)."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(sorted(SOURCES))}")
    return partial(SOURCES[name])
