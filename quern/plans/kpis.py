"""Business measures. Facts are never joined to each other; each measure comes from one fact and its dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_one_fact(*facts: DataFrame) -> None:
    """Refuses frames of two facts: a join of facts would multiply their measures. A fact is told by its counting column."""
    kinds = {c for f in facts for c in ("order_count", "item_line_count", "session_count") if c in f.columns and not (c == "item_line_count" and "order_count" in f.columns)}
    if len(kinds) > 1:
        raise ValueError(f"measures of different facts don't mix: {sorted(kinds)}")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def orders_summary(fact: DataFrame, canceled_statuses: Sequence[str] = ("canceled",), name: str = "canceled") -> DataFrame:
    """name: what the columns about orders of `canceled_statuses` are called after."""
    n, revenue, delivered, canceled = F.sum("order_count"), F.sum("total_payment_value"), F.count_if("is_delivered"), F.count_if(F.col("order_status").isin(*canceled_statuses))
    return fact.agg(
        revenue.alias("total_revenue"), n.alias("total_orders"), F.countDistinct("customer_id").alias("total_customers"), ratio(revenue, n).alias("average_order_value"), delivered.alias("delivered_orders"), ratio(delivered, n).alias("delivered_rate"),
        canceled.alias(f"{name}_orders"), ratio(canceled, n).alias(f"{name}_rate"), F.avg("delivery_days").alias("avg_delivery_days"),
    )


def items_summary(fact: DataFrame) -> DataFrame:
    goods, freight = F.sum("merchandise_value"), F.sum("freight_value")
    return fact.agg(
        F.sum("quantity").cast("long").alias("items_sold"), goods.alias("merchandise_value"), freight.alias("freight_value"), F.sum("item_total_value").alias("order_item_value"), F.countDistinct("order_id").alias("item_orders"), F.countDistinct("product_id").alias("distinct_products"),
        F.countDistinct("seller_id").alias("active_sellers"), F.avg(F.col("unit_price").cast("double")).alias("avg_price_per_item"), ratio(freight, goods + freight).alias("freight_share"),
    )


def sessions_summary(fact: DataFrame) -> DataFrame:
    n, events, cross = F.sum("session_count"), F.sum("event_count"), F.count_if("is_cross_date_session")
    return fact.agg(n.alias("sessions"), events.alias("events"), ratio(events, n).alias("events_per_session"), F.avg("session_duration_seconds").alias("avg_session_duration_seconds"), cross.alias("cross_date_sessions"), ratio(cross, n).alias("cross_date_rate"))


def daily_summary(daily: DataFrame) -> DataFrame:
    return daily.agg(F.avg("active_session_count").alias("avg_daily_active_sessions"), F.avg("distinct_item_count").alias("avg_daily_items"))


def weather_summary(fact: DataFrame, by: str = "warehouse_id") -> DataFrame:
    return fact.groupBy(by).agg(F.avg("temperature_2m").alias("avg_temperature"), F.avg("relative_humidity_2m").alias("avg_humidity"), F.avg("wind_speed_10m").alias("avg_wind"), F.sum("precipitation").alias("total_precipitation"))


def latest_snapshot(forecast: DataFrame) -> DataFrame:
    """Forecast rows of the last snapshot of each warehouse, as measures must not mix snapshots."""
    last = forecast.groupBy("warehouse_id").agg(F.max("snapshot_at").alias("snapshot_at"))
    return forecast.join(last, ["warehouse_id", "snapshot_at"], "left_semi")


def monthly_trend(fact: DataFrame, dates: DataFrame) -> DataFrame:
    d = F.broadcast(dates.select(F.col("date_key").alias("purchase_date_key"), "year", "month"))  # a row a day
    return fact.join(d, "purchase_date_key", "left").groupBy("year", "month").agg(F.sum("order_count").alias("orders"), F.sum("total_payment_value").alias("revenue"))


def by_state(fact: DataFrame, customers: DataFrame) -> DataFrame:
    return fact.join(customers.select("customer_id", "state_code"), "customer_id", "left").groupBy("state_code").agg(F.sum("order_count").alias("orders"), F.sum("total_payment_value").alias("revenue"))


def by_column(fact: DataFrame, column: str) -> DataFrame:
    return fact.groupBy(column).agg(F.sum("order_count").alias("orders"), F.sum("total_payment_value").alias("revenue"))


def by_category(items: DataFrame, products: DataFrame) -> DataFrame:
    return items.join(products.select("product_id", "category_name"), "product_id", "left").groupBy("category_name").agg(F.sum("quantity").cast("long").alias("items_sold"), F.sum("merchandise_value").alias("merchandise_value"))


def top_products(items: DataFrame, n: int = 10) -> DataFrame:
    """The report's length is its feature; ties go to the smaller id."""
    sums = items.groupBy("product_id").agg(F.sum("merchandise_value").alias("merchandise_value"), F.sum("quantity").cast("long").alias("items_sold"))
    return sums.orderBy(F.desc("merchandise_value"), "product_id").limit(n)
