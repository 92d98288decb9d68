"""Intermediate models, dimensions and facts as functions from data frames to data frames."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalar import date_key, hours_between, iso_weekday, seconds_between

ITEM_MEASURES = ("item_line_count", "total_quantity", "distinct_product_count", "distinct_seller_count", "distinct_warehouse_count", "merchandise_value", "total_freight_value")
PAYMENT_MEASURES = ("payment_count", "total_payment_value", "max_payment_installments", "payment_type_count")
LIFECYCLE = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")
COORDINATES = ("requested_latitude", "requested_longitude", "response_latitude", "response_longitude")
MEASURES = ("temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "weather_code")


def distinct_small(c: str):
    """count(distinct) for groups that are small by nature: a set in one pass instead of a row for each distinct column."""
    return F.size(F.collect_set(c)).cast("long")


def item_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("item_line_count"), F.sum("quantity").cast("long").alias("total_quantity"), distinct_small("product_id").alias("distinct_product_count"),
        distinct_small("seller_id").alias("distinct_seller_count"), distinct_small("warehouse_id").alias("distinct_warehouse_count"),
        F.sum(F.col("price") * F.col("quantity")).cast("decimal(38,2)").alias("merchandise_value"), F.sum("freight_value").cast("decimal(38,2)").alias("total_freight_value"),
    ]


def payment_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("payment_count"), F.sum("payment_value").cast("decimal(38,2)").alias("total_payment_value"),
        F.max("payment_installments").alias("max_payment_installments"), distinct_small("payment_type").alias("payment_type_count"),
    ]


def int_order_items_agg(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(*item_measures())


def int_order_payments_agg(payments: DataFrame) -> DataFrame:
    return payments.groupBy("order_id").agg(*payment_measures())


def int_orders_enriched(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    return enriched(orders.join(int_order_items_agg(items), "order_id", "left").join(int_order_payments_agg(payments), "order_id", "left"))


def enriched(rows: DataFrame) -> DataFrame:
    """Orders that have been joined with the measures of their items and payments, each null where there is none."""
    delivered = F.col("order_delivered_customer_date").isNotNull()
    return rows.select(
        "order_id", "customer_id", F.col("warehouse_id").alias("order_warehouse_id"), "order_status", *LIFECYCLE, *ITEM_MEASURES, *PAYMENT_MEASURES,
        F.col("item_line_count").isNotNull().alias("has_items"), F.col("payment_count").isNotNull().alias("has_payment"), F.col("warehouse_id").isNotNull().alias("has_order_warehouse"), delivered.alias("is_delivered"),
        F.when(delivered, F.datediff(F.to_date("order_delivered_customer_date"), F.to_date("order_purchase_timestamp"))).cast("int").alias("delivery_days"), "source_system", "created_at", "updated_at",
    )


def fact_orders(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    return with_order_keys(int_orders_enriched(orders, items, payments))


def with_order_keys(rows: DataFrame) -> DataFrame:
    names = ("purchase_date_key", "approved_date_key", "carrier_date_key", "delivered_date_key", "estimated_delivery_date_key")
    return rows.select("*", *[date_key(c).alias(n) for c, n in zip(LIFECYCLE, names, strict=True)], F.lit(1).alias("order_count"))


def fact_order_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines without an order are dropped; freight is for the line, not for each piece."""
    o = orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp")
    goods = F.col("price") * F.col("quantity")
    return items.join(o, "order_id").select(
        "order_id", "order_item_id", "customer_id", "product_id", "seller_id", "warehouse_id", "order_status", "order_purchase_timestamp", "shipping_limit_date",
        date_key("order_purchase_timestamp").alias("purchase_date_key"), date_key("shipping_limit_date").alias("shipping_limit_date_key"), "quantity", F.col("price").alias("unit_price"), "freight_value",
        goods.cast("decimal(38,2)").alias("merchandise_value"), (goods + F.col("freight_value")).cast("decimal(38,2)").alias("item_total_value"), F.lit(1).alias("item_line_count"), "created_at", "updated_at",
    )


def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "customer_unique_id", F.col("customer_zip_code_prefix").alias("zip_code_prefix"), F.col("customer_city").alias("city"), F.col("customer_state").alias("state_code"), "created_at", "updated_at")


def dim_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", F.col("seller_zip_code_prefix").alias("zip_code_prefix"), F.col("seller_city").alias("city"), F.col("seller_state").alias("state_code"), "created_at", "updated_at")


def dim_warehouses(warehouses: DataFrame) -> DataFrame:
    return warehouses.select("warehouse_id", F.col("warehouse_city").alias("city"), F.col("warehouse_region").alias("region"), "created_at", "updated_at")


def dim_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Categories without a translation keep a null."""
    return products.join(translation.select("product_category_name", "product_category_name_english"), "product_category_name", "left").select(
        "product_id", F.col("product_category_name").alias("category_name"), F.col("product_category_name_english").alias("category_name_english"), F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"), "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm", "created_at", "updated_at",
    )


def calendar(days: DataFrame) -> DataFrame:
    """What a date says about itself. days: (date_day)."""
    d = F.col("date_day")
    return days.select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week_of_year"),
        F.dayofmonth(d).alias("day_of_month"), iso_weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (F.weekday(d) >= 5).alias("is_weekend"),
    )


def dim_date(spark: SparkSession, first: date = date(2014, 1, 1), last: date = date(2027, 12, 31)) -> DataFrame:
    return calendar(spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("date_day")))


def dim_date_of(rows: DataFrame, column: str) -> DataFrame:
    """Every day from the first to the last that a table has; none if it has none."""
    ends = rows.agg(F.min(column).cast("date").alias("first"), F.max(column).cast("date").alias("last")).where("first is not null")
    return calendar(ends.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date_day")))


def int_clickstream_sessions(events: DataFrame) -> DataFrame:
    """Sessions by their id; a gap in time doesn't end one."""
    ts = F.col("event_timestamp")
    return events.groupBy("session_id").agg(
        F.min(ts).alias("session_start_at"), F.max(ts).alias("session_end_at"), F.min("event_date").alias("session_start_date"), F.max("event_date").alias("session_end_date"),
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("item_id").alias("distinct_item_count"), F.countDistinct("category").alias("distinct_category_count"),
    ).withColumn("session_duration_seconds", seconds_between(F.col("session_end_at"), F.col("session_start_at")))


def fact_clickstream_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id", "session_start_at", "session_end_at", date_key("session_start_date").alias("start_date_key"), date_key("session_end_date").alias("end_date_key"), "event_count", "session_duration_seconds",
        (F.col("session_start_date") != F.col("session_end_date")).alias("is_cross_date_session"), F.lit(1).alias("session_count"),
    )


def agg_clickstream_daily(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Days with events; `sessions_started` is null where no session started."""
    started = sessions.groupBy(F.col("session_start_date").alias("event_date")).agg(F.count(F.lit(1)).alias("sessions_started"), F.avg("session_duration_seconds").alias("avg_session_duration_seconds"))
    daily = events.groupBy("event_date").agg(
        F.countDistinct("session_id").alias("active_session_count"), F.count(F.lit(1)).alias("event_count"), F.countDistinct("item_id").alias("distinct_item_count"), F.countDistinct("category").alias("distinct_category_count")
    )
    return daily.join(started, "event_date", "left").select(
        date_key("event_date").alias("date_key"), "event_date", "sessions_started", "active_session_count", "event_count", "distinct_item_count", "distinct_category_count", "avg_session_duration_seconds"
    )


def fact_weather_forecast_hourly(silver: DataFrame) -> DataFrame:
    return silver.select(
        "warehouse_id", "ingestion_id", "snapshot_at", "retrieved_at", "forecast_time", date_key("snapshot_at").alias("snapshot_date_key"), date_key("forecast_time").alias("forecast_date_key"),
        F.hour("forecast_time").alias("forecast_hour"), hours_between(F.col("forecast_time"), F.col("snapshot_at")).alias("forecast_horizon_hours"), *MEASURES, *COORDINATES,
    )


def fact_weather_historical_forecast_hourly(silver: DataFrame) -> DataFrame:
    return silver.select(
        "warehouse_id", "weather_time", date_key("weather_time").alias("weather_date_key"), F.hour("weather_time").alias("weather_hour"), *MEASURES, "ingestion_id", "retrieved_at", "window_start", "window_end", *COORDINATES
    )
