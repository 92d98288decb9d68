"""The column tests of all layers as queries. Each table has some nulls and repeated rows put in by a number of its own, so that every test finds some."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import views as V
from quern.catalogue import AGG_DAILY, FACT_ORDERS, FACT_SESSIONS, FORECAST, agg_daily, dim_customers, dim_date, dim_products, dim_sellers, dim_warehouses, dk, fact_order_items, fact_orders, fact_sessions, history, int_order_items_agg, int_order_payments_agg, int_orders_enriched, query, sessions, stock, weather_forecast, weather_historical
from quern.operators.constraints import Tests, answers

# Columns that hold no null and columns that are a key, by table.
CONTRACT = {
    "orders": Tests(("order_id",), (("order_id",),)),
    "customers": Tests(("customer_id",), (("customer_id",),)),
    "warehouses": Tests(("warehouse_id",), (("warehouse_id",),)),
    "product_category_name_translation": Tests(("product_category_name",), (("product_category_name",),)),
    "sellers": Tests(("seller_id",), (("seller_id",),)),
    "products": Tests(("product_id",), (("product_id",),)),
    "geolocation": Tests(("geolocation_id",), (("geolocation_id",),)),
    "order_items": Tests(("order_id", "order_item_id")),
    "order_payments": Tests(("order_id", "payment_sequential")),
    "order_reviews": Tests(("review_id", "order_id")),
    "inventory": Tests(("warehouse_id", "product_id")),
    "clicks": Tests(("session_id", "event_timestamp", "event_date", "item_id")),
    "weather_forecast_hourly": Tests(("warehouse_id", "ingestion_id", "snapshot_at", "forecast_time")),
    "weather_historical_forecast_hourly": Tests(("warehouse_id", "weather_time", "ingestion_id")),
    "int_order_items_agg": Tests(("order_id", "item_line_count", "total_quantity", "merchandise_value", "total_freight_value"), (("order_id",),)),
    "int_order_payments_agg": Tests(("order_id", "payment_count", "total_payment_value"), (("order_id",),)),
    "int_orders_enriched": Tests(("order_id", "customer_id", "order_status", "has_items", "has_payment", "has_order_warehouse", "is_delivered"), (("order_id",),)),
    "int_clickstream_sessions": Tests(("session_id", "session_start_at", "session_end_at", "session_start_date", "session_end_date", "event_count", "distinct_item_count", "distinct_category_count", "session_duration_seconds"), (("session_id",),)),
    "dim_customers": Tests(("customer_id", "customer_unique_id"), (("customer_id",),)),
    "dim_products": Tests(("product_id",), (("product_id",),)),
    "dim_sellers": Tests(("seller_id",), (("seller_id",),)),
    "dim_warehouses": Tests(("warehouse_id", "city", "region"), (("warehouse_id",),)),
    "dim_date": Tests(("date_key", "date_day", "year", "month", "day_of_week"), (("date_key",), ("date_day",))),
    "fact_orders": Tests(("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_count", "has_items", "has_payment", "is_delivered", "purchase_date_key"), (("order_id",),)),
    "fact_order_items": Tests(("order_id", "order_item_id", "customer_id", "product_id", "seller_id", "quantity", "unit_price", "freight_value", "merchandise_value", "item_line_count", "purchase_date_key")),
    "fact_clickstream_sessions": Tests(("session_id", "session_start_at", "session_end_at", "start_date_key", "end_date_key", "event_count", "session_duration_seconds", "is_cross_date_session", "session_count"), (("session_id",),)),
    "agg_clickstream_daily": Tests(("date_key", "event_date", "event_count", "active_session_count", "distinct_item_count", "distinct_category_count", "sessions_started"), (("date_key",), ("event_date",))),
    "fact_weather_forecast_hourly": Tests(("warehouse_id", "ingestion_id", "snapshot_at", "forecast_time", "snapshot_date_key", "forecast_date_key", "forecast_hour", "forecast_horizon_hours", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "weather_code")),
    "fact_weather_historical_forecast_hourly": Tests(("warehouse_id", "weather_time", "weather_date_key", "weather_hour", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "weather_code")),
}

NAMED = "(VALUES " + ", ".join(map(repr, V.WAREHOUSES)) + ") w(warehouse_id, city, region)"
#: Table in SQL, and the number of a row: 0 repeats it, n takes the n-th tested column away.
TABLES_SQL = {
    "orders": ("stg_orders", "order_id % 97"), "customers": ("(SELECT c_custkey AS customer_id FROM customer)", "customer_id % 97"), "warehouses": (f"(SELECT * FROM {NAMED})", "length(warehouse_id) - 5"),
    "product_category_name_translation": ("(SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in V.TRANSLATED) + ") t(product_category_name))", "length(product_category_name) % 6"),
    "sellers": ("(SELECT s_suppkey AS seller_id FROM supplier)", "seller_id % 9"), "products": ("(SELECT p_partkey AS product_id FROM part)", "product_id % 97"), "geolocation": ("(SELECT n_nationkey AS geolocation_id FROM nation)", "geolocation_id % 7"),
    "order_items": ("stg_order_items", "order_id % 97"), "order_payments": ("stg_order_payments", "order_id % 97"), "order_reviews": ("(SELECT l_orderkey % 5000 AS review_id, l_orderkey AS order_id FROM lineitem WHERE l_linenumber = 1)", "order_id % 97"),
    "inventory": ("stg_inventory", "product_id % 97"), "clicks": ("clicks", "session_id % 97"), "weather_forecast_hourly": ("stg_weather", "relative_humidity_2m % 50"), "weather_historical_forecast_hourly": ("stg_history", "relative_humidity_2m % 50"),
    "int_order_items_agg": ("stg_items_agg", "order_id % 97"), "int_order_payments_agg": ("stg_payments_agg", "order_id % 97"), "int_orders_enriched": ("stg_enriched", "order_id % 97"), "int_clickstream_sessions": ("stg_sessions", "session_id % 97"),
    "dim_customers": ("(SELECT c_custkey AS customer_id, c_name AS customer_unique_id FROM customer)", "customer_id % 97"), "dim_products": ("(SELECT p_partkey AS product_id FROM part)", "product_id % 97"), "dim_sellers": ("(SELECT s_suppkey AS seller_id FROM supplier)", "seller_id % 9"),
    "dim_warehouses": (f"(SELECT * FROM {NAMED})", "length(warehouse_id) - 5"), "dim_date": ("(SELECT *, CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(day AS DATE) AS date_day, year(day) AS year, month(day) AS month, isodow(day) AS day_of_week FROM (SELECT unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS day))", "date_key % 31"),
    "fact_orders": (f"({FACT_ORDERS})", "order_id % 97"), "fact_order_items": ("stg_fact_items", "order_id % 97"), "fact_clickstream_sessions": (f"({FACT_SESSIONS})", "session_id % 97"), "agg_clickstream_daily": (f"({AGG_DAILY})", "day(event_date) - 1"),
    "fact_weather_forecast_hourly": (f"({FORECAST})", "relative_humidity_2m % 50"), "fact_weather_historical_forecast_hourly": (f"(SELECT *, {dk('weather_time')} AS weather_date_key, hour(weather_time) AS weather_hour FROM stg_resolved)", "relative_humidity_2m % 50"),
}


def frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    items, h = V.stg_order_items(spark, d), history(spark, d)
    nation = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("geolocation_id"))
    return {
        "orders": V.stg_orders(spark, d), "customers": V.stg_customers(spark, d), "warehouses": V.stg_warehouses(spark), "product_category_name_translation": V.stg_translation(spark), "sellers": V.stg_sellers(spark, d), "products": V.stg_products(spark, d), "geolocation": nation,
        "order_items": items, "order_payments": V.stg_order_payments(items), "order_reviews": V.stg_order_reviews(spark, d), "inventory": stock(spark, d), "clicks": V.clicks(spark, d), "weather_forecast_hourly": weather_forecast(spark, d), "weather_historical_forecast_hourly": h,
        "int_order_items_agg": int_order_items_agg(spark, d), "int_order_payments_agg": int_order_payments_agg(spark, d), "int_orders_enriched": int_orders_enriched(spark, d), "int_clickstream_sessions": sessions(spark, d),
        "dim_customers": dim_customers(spark, d), "dim_products": dim_products(spark, d), "dim_sellers": dim_sellers(spark, d), "dim_warehouses": dim_warehouses(spark, d), "dim_date": dim_date(spark, d),
        "fact_orders": fact_orders(spark, d), "fact_order_items": fact_order_items(spark, d), "fact_clickstream_sessions": fact_sessions(spark, d), "agg_clickstream_daily": agg_daily(spark, d), "fact_weather_forecast_hourly": weather_forecast(spark, d),
        "fact_weather_historical_forecast_hourly": weather_historical(spark, d),
    }


def flawed(df: DataFrame, table: str) -> DataFrame:
    """The tested columns of a table with its flaws; for the tests' own columns only, so that nothing else is read."""
    tested, number = CONTRACT[table].not_null, TABLES_SQL[table][1]
    rows = df.select(F.expr(number).alias("__number"), *tested)
    rows = rows.select("__number", *[F.when(F.col("__number") != i + 1, F.col(c)).when(F.col("__number").isNull(), F.col(c)).alias(c) for i, c in enumerate(tested)])
    times = F.when(F.col("__number") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("__time", F.explode(times)).select(*tested)


def flawed_sql(table: str) -> str:
    tested, (source, number) = CONTRACT[table].not_null, TABLES_SQL[table]
    columns = ", ".join(f"CASE WHEN {number} = {i + 1} THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(tested))
    return f"(SELECT {columns} FROM (SELECT * FROM {source} UNION ALL SELECT * FROM {source} WHERE {number} = 0))"


def not_null_sql(table: str) -> list[str]:
    tested = CONTRACT[table].not_null
    return [f"SELECT unnest([{', '.join(repr(f'not_null_{table}_{c}') for c in tested)}]) AS check_name, unnest([{', '.join(f'count(*) FILTER ({c} IS NULL)' for c in tested)}]) AS failures FROM {flawed_sql(table)}"]


def unique_sql(table: str) -> list[str]:
    return [f"SELECT 'unique_{table}_{k[0]}' AS check_name, count(*) AS failures FROM (SELECT 1 FROM {flawed_sql(table)} WHERE {k[0]} IS NOT NULL GROUP BY {k[0]} HAVING count(*) > 1)" for k in CONTRACT[table].keys]


def asked(spark: SparkSession, d: str, tests: Mapping[str, Tests]) -> DataFrame:
    tables = frames(spark, d)
    return answers({t: flawed(tables[t], t) for t in tests}, tests)


@query("dq_not_null_all", " UNION ALL ".join(s for t in CONTRACT for s in not_null_sql(t)))
def dq_not_null_all(spark: SparkSession, d: str) -> DataFrame:
    """All 120 columns that hold no null; each table is read once, without an exchange of its own."""
    return asked(spark, d, {n: Tests(t.not_null) for n, t in CONTRACT.items()})


@query("dq_unique_all", " UNION ALL ".join(s for t in CONTRACT for s in unique_sql(t)))
def dq_unique_all(spark: SparkSession, d: str) -> DataFrame:
    """All 21 keys of one column."""
    return asked(spark, d, {n: Tests((), t.keys) for n, t in CONTRACT.items() if t.keys})


@query("dq_column_tests", " UNION ALL ".join(s for t in ("fact_orders", "int_clickstream_sessions", "agg_clickstream_daily", "dim_customers", "fact_order_items") for s in not_null_sql(t) + unique_sql(t)))
def dq_column_tests(spark: SparkSession, d: str) -> DataFrame:
    """Nulls and keys of five tables at once: the null counts ride along with the exchange of a table's first key."""
    return asked(spark, d, {n: CONTRACT[n] for n in ("fact_orders", "int_clickstream_sessions", "agg_clickstream_daily", "dim_customers", "fact_order_items")})
