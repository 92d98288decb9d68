"""Queries of data-quality checks on whole layers: foreign keys, composite keys, weather, seed load."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quern import views as V
from quern.catalogue import AGG_DAILY, FACT_ORDERS, FACT_SESSIONS, FORECAST, agg_daily, dk, enriched_inputs, fact_order_items, fact_orders, fact_sessions, history, query, reported, stock, weather_forecast, weather_inputs
from quern.operators import quality, weather
from quern.plans import marts as M

# What the parents of the foreign keys lack, so that there is something to find.
DAYS = (date(1996, 1, 1), date(1999, 12, 31))
EVENT_DAYS = (date(2024, 1, 3), date(2024, 1, 20))


def dates_sql(days: tuple[date, date]) -> str:
    return f"(SELECT CAST(strftime(x, '%Y%m%d') AS INTEGER) AS k FROM (SELECT unnest(generate_series(DATE '{days[0]}', DATE '{days[1]}', INTERVAL 1 DAY)) AS x))"


FACTS_SQL = {
    "orders": f"({FACT_ORDERS})", "items": "(SELECT * FROM stg_fact_items)", "sessions": f"({FACT_SESSIONS})", "daily": f"({AGG_DAILY})",
    "history": f"(SELECT warehouse_id, {dk('weather_time')} AS weather_date_key FROM stg_resolved)", "forecast": f"({FORECAST})",
}
PARENTS_SQL = {
    "dates": dates_sql(DAYS), "event_dates": dates_sql(EVENT_DAYS), "orders": "(SELECT order_id AS k FROM stg_orders WHERE order_id % 50 <> 0)", "customers": "(SELECT c_custkey AS k FROM customer WHERE c_custkey % 100 <> 0)",
    "products": "(SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 0)", "sellers": "(SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0)",
    "warehouses": "(SELECT * FROM (VALUES " + ", ".join(f"('{w[0]}')" for w in V.WAREHOUSES if w[0] != "WH_HP") + ") w(k))",
}
#: Child, column, parent.
RELATIONSHIPS = (
    *(("orders", f"{x}_date_key", "dates") for x in ("purchase", "approved", "carrier", "delivered", "estimated_delivery")),
    ("items", "order_id", "orders"), ("items", "customer_id", "customers"), ("items", "product_id", "products"), ("items", "seller_id", "sellers"), ("items", "warehouse_id", "warehouses"),
    ("items", "purchase_date_key", "dates"), ("items", "shipping_limit_date_key", "dates"), ("sessions", "start_date_key", "event_dates"), ("sessions", "end_date_key", "event_dates"), ("daily", "date_key", "event_dates"),
    ("history", "warehouse_id", "warehouses"), ("history", "weather_date_key", "event_dates"), ("forecast", "warehouse_id", "warehouses"), ("forecast", "snapshot_date_key", "event_dates"), ("forecast", "forecast_date_key", "event_dates"),
)


@query("dq_relationships_all", " UNION ALL ".join(f"SELECT 'relationship_{c}_{k}' AS check_name, count(*) AS failures FROM {FACTS_SQL[c]} c WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {PARENTS_SQL[p]} p WHERE p.k = c.{k})" for c, k, p in RELATIONSHIPS))
def dq_relationships_all(spark, d):
    """All twenty foreign keys of the facts; each fact is read once. Calendars and warehouses are broadcast, being of fixed size."""
    h = M.fact_weather_historical_forecast_hourly(weather.resolved(history(spark, d)))
    facts = {"orders": fact_orders(spark, d), "items": fact_order_items(spark, d), "sessions": fact_sessions(spark, d), "daily": agg_daily(spark, d), "history": h, "forecast": weather_forecast(spark, d)}
    days = lambda x: F.broadcast(M.dim_date(spark, *x).select(F.col("date_key").alias("k")))
    parents = {
        "dates": days(DAYS), "event_dates": days(EVENT_DAYS), "orders": V.read(spark, d, "orders").select(F.col("o_orderkey").alias("k")).where("k % 50 <> 0"), "customers": V.stg_customers(spark, d).select(F.col("customer_id").alias("k")).where("k % 100 <> 0"),
        "products": V.stg_products(spark, d).select(F.col("product_id").alias("k")).where("k % 10 <> 0"), "sellers": V.stg_sellers(spark, d).select(F.col("seller_id").alias("k")).where("k % 7 <> 0"),
        "warehouses": F.broadcast(V.stg_warehouses(spark).select(F.col("warehouse_id").alias("k")).where("k <> 'WH_HP'")),
    }
    return quality.all_checks(*[quality.relationships(facts[f], [(k, parents[p], "k", f"{c}_{k}") for c, k, p in RELATIONSHIPS if c == f]) for f in facts])


REVIEWS_SQL = "(SELECT l_orderkey % 5000 AS review_id, l_orderkey AS order_id FROM lineitem WHERE l_linenumber = 1)"
#: Check, table in SQL, key. Lines and payments before the latest version is taken repeat; so do hours of windows that overlap.
KEYS = (
    ("order_items", "stg_versions", ("order_id", "order_item_id")), ("order_payments", "(SELECT order_id, order_item_id AS payment_sequential FROM stg_versions)", ("order_id", "payment_sequential")),
    ("order_reviews", REVIEWS_SQL, ("review_id", "order_id")), ("inventory", "stg_inventory", ("warehouse_id", "product_id")), ("weather_forecast", "stg_weather", ("warehouse_id", "ingestion_id", "forecast_time")),
    ("weather_historical", "stg_history", ("warehouse_id", "weather_time")), ("fact_order_items", "stg_fact_items", ("order_id", "order_item_id")), ("fact_weather_historical", "stg_resolved", ("warehouse_id", "weather_time")),
)


@query("dq_composite_keys", " UNION ALL ".join(f"SELECT 'unique_{n}' AS check_name, count(*) AS failures FROM (SELECT 1 FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} GROUP BY {', '.join(k)} HAVING count(*) > 1)" for n, t, k in KEYS))
def dq_composite_keys(spark, d):
    """The eight keys of several columns."""
    versions, h = V.item_versions(spark, d), history(spark, d)
    tables = {
        "order_items": versions, "order_payments": V.stg_order_payments(versions), "order_reviews": V.stg_order_reviews(spark, d), "inventory": stock(spark, d), "weather_forecast": weather_forecast(spark, d),
        "weather_historical": h, "fact_order_items": fact_order_items(spark, d), "fact_weather_historical": weather.resolved(h),
    }
    return quality.all_checks(*[quality.unique(tables[n], list(k), n) for n, _, k in KEYS])


HOLED = "(SELECT * REPLACE (CASE WHEN relative_humidity_2m = 7 THEN NULL WHEN relative_humidity_2m = 8 THEN 108 WHEN relative_humidity_2m = 9 THEN -9 ELSE relative_humidity_2m END AS relative_humidity_2m, CASE WHEN weather_code = 3 THEN NULL ELSE weather_code END AS weather_code, CASE WHEN precipitation > 0.55 THEN NULL WHEN precipitation > 0.45 THEN -1.0 ELSE precipitation END AS precipitation) FROM {})"


def holed(df):
    """Weather with some values that fail."""
    h, p = F.col("relative_humidity_2m"), F.col("precipitation")
    return df.withColumns({
        "relative_humidity_2m": F.when(h == 7, None).when(h == 8, 108).when(h == 9, -9).otherwise(h), "weather_code": F.when(F.col("weather_code") == 3, None).otherwise(F.col("weather_code")),
        "precipitation": F.when(p > 0.55, None).when(p > 0.45, -1.0).otherwise(p),
    })


def nulls_sql(columns):
    return {n: f"count(*) FILTER ({c} IS NULL)" for c, n in columns.items()}


RANGES_SQL = {
    "humidity_below_0": "count(*) FILTER (relative_humidity_2m < 0)", "humidity_above_100": "count(*) FILTER (relative_humidity_2m > 100)", "negative_precip": "count(*) FILTER (precipitation < 0)",
    "negative_wind": "count(*) FILTER (wind_speed_10m < 0)",
}


def unnested(checks, table):
    return f"SELECT unnest({list(checks)}) AS check_name, unnest([{', '.join(checks.values())}]) AS failures FROM {table}"


HISTORY_SQL = "(SELECT *, CAST(forecast_time + INTERVAL 7 HOUR AS DATE) AS window_start, CAST(forecast_time + INTERVAL 7 HOUR AS DATE) - CASE WHEN weather_code = 2 THEN 1 ELSE 0 END AS window_end, date_trunc('hour', forecast_time) AS weather_time FROM stg_weather)"


@query("dq_history", unnested(nulls_sql(quality.HISTORY_NULLS) | RANGES_SQL | {"invalid_window": "count(*) FILTER (window_start > window_end)"}, HOLED.format(HISTORY_SQL)))
def dq_history(spark, d):
    """The sixteen counters of past hours."""
    h = history(spark, d).withColumn("window_end", F.when(F.col("weather_code") == 2, F.date_sub("window_end", 1)).otherwise(F.col("window_end")))
    return quality.history_checks(holed(h))


@query("dq_forecast", "SELECT 'row_count' AS check_name, CAST((SELECT count(*) FROM stg_weather) <> 48 * (SELECT count(DISTINCT ingestion_id) FROM stg_weather) AS BIGINT) AS failures UNION ALL " + unnested(nulls_sql(quality.FORECAST_NULLS) | RANGES_SQL, HOLED.format("stg_weather"))
       + " UNION ALL SELECT 'duplicate_grain', count(*) FROM (SELECT 1 FROM stg_weather GROUP BY warehouse_id, ingestion_id, forecast_time HAVING count(*) > 1)")
def dq_forecast(spark, d):
    """The nine failures of forecast hours."""
    responses, metadata = weather_inputs(spark, d)
    return quality.forecast_checks(holed(weather.forecast_silver(responses, metadata)), metadata.count())


DUE = "(SELECT DISTINCT ingestion_id FROM stg_weather)"
NUMBER = "CAST(regexp_extract(ingestion_id, 'ing-([0-9]+)', 1) AS BIGINT)"


@query("dq_history_completeness", f""", e AS (SELECT ingestion_id AS i FROM {DUE} WHERE {NUMBER} % 11 <> 0 UNION ALL SELECT 'ing-lost'), m AS (SELECT ingestion_id AS i, 24 AS expected FROM {DUE} WHERE {NUMBER} % 13 <> 0),
 a AS (SELECT ingestion_id AS i, count(*) AS n, count(DISTINCT weather_time) AS h FROM stg_history WHERE {NUMBER} % 7 <> 0 GROUP BY 1)
 SELECT 'missing_metadata' AS check_name, count(*) AS failures FROM e WHERE i NOT IN (SELECT i FROM m) UNION ALL SELECT 'missing_ingestions', count(*) FROM e WHERE i NOT IN (SELECT i FROM a)
 UNION ALL SELECT 'unexpected_ingestions', count(*) FROM a WHERE i NOT IN (SELECT i FROM e) UNION ALL SELECT 'invalid_row_counts', count(*) FROM a JOIN m USING (i) WHERE n <> expected OR h <> expected
 UNION ALL SELECT 'total_row_mismatch', CAST((SELECT sum(expected) FROM m) <> (SELECT sum(n) FROM a) AS BIGINT)""")
def dq_history_completeness(spark, d):
    """Ingestions that are due, announced and there, each with some missing."""
    _, metadata = weather_inputs(spark, d)
    number = F.regexp_extract("ingestion_id", "ing-([0-9]+)", 1).cast("long")
    expected = metadata.select("ingestion_id").where(number % 11 != 0).unionByName(spark.createDataFrame([("ing-lost",)], "ingestion_id string"))
    return quality.history_completeness(history(spark, d).where(number % 7 != 0), metadata.where(number % 13 != 0), expected)


SEED_SQL = {
    "orders_customers": "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 100 <> 0)", "items_orders": "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "items_products": "SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)", "items_sellers": "SELECT count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0)",
    "payments_orders": "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)", "reviews_orders": f"SELECT count(*) FROM {REVIEWS_SQL} WHERE order_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)",
}


@query("dq_seed_orphans", " UNION ALL ".join(f"SELECT 'relationship_{n}' AS check_name, ({q}) AS failures" for n, q in SEED_SQL.items()))
def dq_seed_orphans(spark, d):
    """The six foreign keys of a seed load."""
    from quern.sources.seed import orphan_checks

    orders = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    lines = V.item_versions(spark, d)
    some = orders.where("order_id % 50 <> 0")
    tables = {"orders": orders, "customers": V.stg_customers(spark, d).where("customer_id % 100 <> 0"), "order_items": lines, "products": V.stg_products(spark, d).where("product_id % 10 <> 0"), "sellers": V.stg_sellers(spark, d).where("seller_id % 7 <> 0")}
    more = {"order_payments": V.stg_order_payments(lines), "order_reviews": V.stg_order_reviews(spark, d)}
    checks = orphan_checks(tables), orphan_checks(more | {"orders": some})
    return quality.all_checks(*[c for c in checks if c is not None])
