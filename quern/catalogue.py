"""The queries of the library by name, on the test tables, each with the same query as SQL.

Money is decimal inside the models; results give it as double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import views as V
from quern.functions.scalar import path_date, path_value, request_id_of, window_rows
from quern.operators import clickstream, inventory, quality, weather
from quern.operators import versions as R
from quern.plans import kpis as K
from quern.plans import marts as M

Query = Callable[[SparkSession, str], DataFrame]
#: The statuses of the test tables: finished, open, pending.
STATUSES = quality.Statuses(("F", "O", "P"), ("P",), ("F",), ("P",), ("F", "O"))
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def reported(df: DataFrame) -> DataFrame:
    """Decimals as doubles, instants as plain UTC times, arrays and structs as they are."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: reported(f(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH {PRELUDE} {sql}" if "stg_" in sql or "clicks" in sql else sql
        return f

    return add


def warehouse_sql(key: str) -> str:
    return f"CASE WHEN {key} % 20 < 6 THEN 'WH_HCM' WHEN {key} % 20 < 11 THEN 'WH_HN' WHEN {key} % 20 < 15 THEN 'WH_DN' WHEN {key} % 20 < 18 THEN 'WH_CT' ELSE 'WH_HP' END"


def dk(c: str) -> str:
    return f"CAST(strftime(CAST({c} AS DATE), '%Y%m%d') AS INTEGER)"


PRELUDE = f"""
stg_versions AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
    CAST(l_extendedprice AS DECIMAL(10,2)) AS price, CAST(l_tax AS DECIMAL(10,2)) AS freight_value, CASE WHEN l_partkey % 50 <> 0 THEN {warehouse_sql('l_suppkey')} END AS warehouse_id,
    CAST(l_quantity AS INTEGER) AS quantity, l_returnflag AS return_flag, l_shipdate AS created_at, l_shipdate AS updated_at
  FROM lineitem),
stg_order_items AS (
  SELECT * FROM stg_versions QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id
    ORDER BY updated_at DESC, product_id DESC, seller_id DESC, price DESC, quantity DESC, freight_value DESC, return_flag DESC) = 1),
stg_order_payments AS (
  SELECT order_id, order_item_id AS payment_sequential, return_flag AS payment_type, order_item_id AS payment_installments, price AS payment_value FROM stg_order_items),
stg_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, {warehouse_sql('o_orderkey')} AS warehouse_id, o_orderstatus AS order_status, o_orderdate AS order_purchase_timestamp,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 1 HOUR END AS order_approved_at, CASE WHEN o_orderstatus = 'F' THEN first_ship END AS order_delivered_carrier_date,
    CASE WHEN o_orderstatus = 'F' THEN last_ship END AS order_delivered_customer_date, o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date, 'seed' AS source_system, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
stg_items_agg AS (
  SELECT order_id, count(*) AS item_line_count, CAST(sum(quantity) AS BIGINT) AS total_quantity, count(DISTINCT product_id) AS distinct_product_count, count(DISTINCT seller_id) AS distinct_seller_count,
    count(DISTINCT warehouse_id) AS distinct_warehouse_count, sum(price * quantity) AS merchandise_value, sum(freight_value) AS total_freight_value FROM stg_order_items GROUP BY 1),
stg_payments_agg AS (
  SELECT order_id, count(*) AS payment_count, sum(payment_value) AS total_payment_value, max(payment_installments) AS max_payment_installments, count(DISTINCT payment_type) AS payment_type_count FROM stg_order_payments GROUP BY 1),
stg_enriched AS (
  SELECT order_id, customer_id, warehouse_id AS order_warehouse_id, order_status, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date,
    item_line_count, total_quantity, distinct_product_count, distinct_seller_count, distinct_warehouse_count, CAST(merchandise_value AS DOUBLE) AS merchandise_value, CAST(total_freight_value AS DOUBLE) AS total_freight_value,
    payment_count, CAST(total_payment_value AS DOUBLE) AS total_payment_value, max_payment_installments, payment_type_count, item_line_count IS NOT NULL AS has_items, payment_count IS NOT NULL AS has_payment,
    warehouse_id IS NOT NULL AS has_order_warehouse, order_delivered_customer_date IS NOT NULL AS is_delivered,
    CAST(date_diff('day', CAST(order_purchase_timestamp AS DATE), CAST(order_delivered_customer_date AS DATE)) AS INTEGER) AS delivery_days, source_system, created_at, updated_at
  FROM stg_orders LEFT JOIN stg_items_agg USING (order_id) LEFT JOIN stg_payments_agg USING (order_id)),
stg_fact_items AS (
  SELECT i.order_id, order_item_id, customer_id, product_id, seller_id, i.warehouse_id, order_status, order_purchase_timestamp, shipping_limit_date, {dk('order_purchase_timestamp')} AS purchase_date_key,
    {dk('shipping_limit_date')} AS shipping_limit_date_key, quantity, price AS unit_price, freight_value, price * quantity AS merchandise_value, price * quantity + freight_value AS item_total_value,
    CAST(1 AS INTEGER) AS item_line_count, i.created_at, i.updated_at
  FROM stg_order_items i JOIN stg_orders o ON i.order_id = o.order_id),
clicks AS (
  SELECT user_id AS session_id, ts AS event_timestamp, CAST(ts AS DATE) AS event_date, CAST(hour(ts) AS INTEGER) AS event_hour, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, event_type AS category FROM events),
stg_sessions AS (
  SELECT session_id, min(event_timestamp) AS session_start_at, max(event_timestamp) AS session_end_at, min(event_date) AS session_start_date, max(event_date) AS session_end_date, count(*) AS event_count,
    count(DISTINCT item_id) AS distinct_item_count, count(DISTINCT category) AS distinct_category_count,
    CAST(round(CAST(epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp)) AS DECIMAL(20,0)) / 1000000.0, 0) AS BIGINT) AS session_duration_seconds FROM clicks GROUP BY 1),
stg_inventory AS (
  SELECT w.warehouse_id, CAST(p_partkey AS BIGINT) AS product_id, CAST((p_partkey * 7 + k * 13) % 500 AS INTEGER) AS quantity_available
  FROM part CROSS JOIN (VALUES (0, 'WH_HCM'), (1, 'WH_HN'), (2, 'WH_DN'), (3, 'WH_CT'), (4, 'WH_HP')) w(k, warehouse_id)
  WHERE k IN (p_partkey % 5, (p_partkey + 1) % 5) OR (p_partkey % 2 = 0 AND k = (p_partkey + 3) % 5)),
stg_weather AS (
  SELECT ['WH_HCM', 'WH_HN', 'WH_DN', 'WH_CT', 'WH_HP'][CAST(user_id % 5 AS INTEGER) + 1] AS warehouse_id, 'ing-' || user_id || '-' || strftime(ts, '%Y%m%d') AS ingestion_id, date_trunc('day', ts) AS snapshot_at, date_trunc('day', ts) AS retrieved_at,
    ts - INTERVAL 7 HOUR AS forecast_time, value AS temperature_2m, CAST(event_id % 101 AS INTEGER) AS relative_humidity_2m, (event_id % 7) / CAST(10 AS DOUBLE) AS precipitation, value / 2 AS wind_speed_10m,
    CAST(event_id % 4 AS INTEGER) AS weather_code, 10.5 + user_id % 5 AS requested_latitude, 106.5 AS requested_longitude, 10.5 + user_id % 5 AS response_latitude, 106.5 AS response_longitude FROM events),
stg_history AS (
  SELECT warehouse_id, date_trunc('hour', forecast_time) AS weather_time, ingestion_id, forecast_time AS retrieved_at, temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m, weather_code FROM stg_weather),
stg_resolved AS (
  SELECT * FROM stg_history QUALIFY row_number() OVER (PARTITION BY warehouse_id, weather_time ORDER BY retrieved_at DESC, ingestion_id DESC, temperature_2m DESC, relative_humidity_2m DESC, precipitation DESC, wind_speed_10m DESC, weather_code DESC) = 1)
"""


def doubles(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


# orders ---------------------------------------------------------------------------------------------------------------


@query("int_order_items_agg", f"SELECT * REPLACE ({doubles('merchandise_value', 'total_freight_value')}) FROM stg_items_agg")
def int_order_items_agg(spark, d):
    return M.int_order_items_agg(V.stg_order_items(spark, d))


@query("int_order_payments_agg", f"SELECT * REPLACE ({doubles('total_payment_value')}) FROM stg_payments_agg")
def int_order_payments_agg(spark, d):
    return M.int_order_payments_agg(V.stg_order_payments(V.stg_order_items(spark, d)))


def enriched_inputs(spark, d):
    items = V.stg_order_items(spark, d)
    return V.stg_orders(spark, d), items, V.stg_order_payments(items)


@query("int_orders_enriched", "SELECT * FROM stg_enriched")
def int_orders_enriched(spark, d):
    """Lines are read and dealt by order once; items, payments and shipping dates come from the same rows."""
    return M.enriched(V.orders_with(spark, d, V.order_measures(V.order_lines(spark, d))))


@query("int_orders_enriched_from_tables", "SELECT * FROM stg_enriched")
def int_orders_enriched_from_tables(spark, d):
    """The same from tables of orders, items and payments, as the domain has them."""
    return M.int_orders_enriched(*enriched_inputs(spark, d))


FACT_ORDERS = f"""SELECT *, {dk('order_purchase_timestamp')} AS purchase_date_key, {dk('order_approved_at')} AS approved_date_key, {dk('order_delivered_carrier_date')} AS carrier_date_key,
  {dk('order_delivered_customer_date')} AS delivered_date_key, {dk('order_estimated_delivery_date')} AS estimated_delivery_date_key, CAST(1 AS INTEGER) AS order_count FROM stg_enriched"""


@query("fact_orders", FACT_ORDERS)
def fact_orders(spark, d):
    return M.with_order_keys(int_orders_enriched(spark, d))


@query("fact_order_items", f"SELECT * REPLACE ({doubles('unit_price', 'freight_value', 'merchandise_value', 'item_total_value')}) FROM stg_fact_items")
def fact_order_items(spark, d):
    return M.fact_order_items(V.stg_order_items(spark, d), V.stg_orders(spark, d))


@query("latest_items", f"SELECT * REPLACE ({doubles('price', 'freight_value')}) FROM stg_order_items")
def latest_items(spark, d):
    return V.stg_order_items(spark, d)


CUT = "2000-01-01"


def old_and_new(spark, d):
    """A table of what was known at a time, and what has come since, each with ingestion times."""
    v = V.item_versions(spark, d).withColumn("_ingested_at", F.col("updated_at"))
    old, new = v.where(F.col("updated_at") < F.lit(CUT).cast("timestamp_ntz")), v.where(F.col("updated_at") >= F.lit(CUT).cast("timestamp_ntz"))
    take = lambda df: R.latest(df, V.ITEM_KEY, V.ITEM_ORDER, clustered_by="order_id")
    return take(old), take(new)


ITEM_COLUMNS = "order_id, order_item_id, product_id, seller_id, CAST(price AS DOUBLE) AS price, quantity, updated_at"
ITEM_ORDER_SQL = "updated_at DESC, product_id DESC, seller_id DESC, price DESC, quantity DESC, freight_value DESC, return_flag DESC"
NEW_SQL = f"(SELECT * FROM stg_versions WHERE updated_at >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id ORDER BY {ITEM_ORDER_SQL}) = 1)"
OLD_SQL = f"(SELECT * FROM stg_versions WHERE updated_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY order_id, order_item_id ORDER BY {ITEM_ORDER_SQL}) = 1)"


def item_columns(df):
    return df.select("order_id", "order_item_id", "product_id", "seller_id", "price", "quantity", "updated_at")


@query("item_changes", f"SELECT {ITEM_COLUMNS} FROM {NEW_SQL} n WHERE NOT EXISTS (SELECT 1 FROM {OLD_SQL} o WHERE o.order_id = n.order_id AND o.order_item_id = n.order_item_id AND o.updated_at >= n.updated_at)")
def item_changes(spark, d):
    old, new = old_and_new(spark, d)
    return item_columns(R.changes(new, old, V.ITEM_KEY))


MERGE_SQL = f"SELECT {ITEM_COLUMNS} FROM {NEW_SQL} n UNION ALL SELECT {ITEM_COLUMNS} FROM {OLD_SQL} o WHERE NOT EXISTS (SELECT 1 FROM {NEW_SQL} n WHERE o.order_id = n.order_id AND o.order_item_id = n.order_item_id)"


@query("merge_items", MERGE_SQL)
def merge_items(spark, d):
    old, new = old_and_new(spark, d)
    return item_columns(R.merged(old, R.changes(new, old, V.ITEM_KEY), V.ITEM_KEY))


@query("merge_items_one_pass", MERGE_SQL)
def merge_items_one_pass(spark, d):
    old, new = old_and_new(spark, d)
    return item_columns(R.merge_newer(old, new, V.ITEM_KEY))


@query("first_per_group", f"SELECT product_id, shipping_limit_date, {doubles('price')}, order_id FROM stg_versions QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY shipping_limit_date DESC NULLS LAST, price DESC, order_id DESC) = 1")
def first_per_group(spark, d):
    return R.first_of_group(V.item_versions(spark, d), "product_id", "shipping_limit_date", ["price", "order_id"]).select("product_id", "shipping_limit_date", "price", "order_id")


# dimensions -----------------------------------------------------------------------------------------------------------


@query("dim_customers", "SELECT c_custkey AS customer_id, c_name AS customer_unique_id, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip_code_prefix, n_name AS city, r_name AS state_code, TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_customers(spark, d):
    return M.dim_customers(V.stg_customers(spark, d))


@query("dim_sellers", "SELECT s_suppkey AS seller_id, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zip_code_prefix, n_name AS city, substr(n_name, 1, 2) AS state_code, TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def dim_sellers(spark, d):
    return M.dim_sellers(V.stg_sellers(spark, d))


@query("dim_warehouses", "SELECT w.*, TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at FROM (VALUES " + ", ".join(map(repr, V.WAREHOUSES)) + f") w(warehouse_id, city, region) WHERE warehouse_id IN (SELECT {warehouse_sql('o_orderkey')} FROM orders)")
def dim_warehouses(spark, d):
    """The warehouses that orders name."""
    named = V.read(spark, d, "orders").select(V.warehouse_of(F.col("o_orderkey")).alias("warehouse_id")).distinct()
    return M.dim_warehouses(V.stg_warehouses(spark)).join(named, "warehouse_id", "left_semi")


@query("dim_products", """SELECT p_partkey AS product_id, split_part(p_type, ' ', 1) AS category_name, CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'STANDARD', 'PROMO') THEN lower(split_part(p_type, ' ', 1)) END AS category_name_english,
 CAST(length(p_name) AS INTEGER) AS product_name_length, CAST(length(p_type) AS INTEGER) AS product_description_length, CAST(p_partkey % 7 AS INTEGER) AS product_photos_qty, CAST(p_size AS DOUBLE) AS product_weight_g,
 CAST(p_size AS DOUBLE) AS product_length_cm, CAST(p_size AS DOUBLE) AS product_height_cm, CAST(NULL AS DOUBLE) AS product_width_cm, TIMESTAMP '1995-01-01' AS created_at, TIMESTAMP '1995-01-01' AS updated_at FROM part""")
def dim_products(spark, d):
    return M.dim_products(V.stg_products(spark, d), F.broadcast(V.stg_translation(spark)))


@query("dim_date", """SELECT CAST(strftime(day, '%Y%m%d') AS INTEGER) AS date_key, CAST(day AS DATE) AS date_day, CAST(year(day) AS INTEGER) AS year, CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month, monthname(day) AS month_name,
 CAST(week(day) AS INTEGER) AS week_of_year, CAST(day(day) AS INTEGER) AS day_of_month, CAST(isodow(day) AS INTEGER) AS day_of_week, dayname(day) AS day_name, isodow(day) >= 6 AS is_weekend
 FROM (SELECT unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS day)""")
def dim_date(spark, d):
    """Every day from the first order to the last."""
    return M.dim_date_of(V.read(spark, d, "orders"), "o_orderdate")


# clickstream ----------------------------------------------------------------------------------------------------------


@query("sessions", "SELECT * FROM stg_sessions")
def sessions(spark, d):
    return M.int_clickstream_sessions(V.clicks(spark, d))


FACT_SESSIONS = f"SELECT session_id, session_start_at, session_end_at, {dk('session_start_date')} AS start_date_key, {dk('session_end_date')} AS end_date_key, event_count, session_duration_seconds, session_start_date <> session_end_date AS is_cross_date_session, CAST(1 AS INTEGER) AS session_count FROM stg_sessions"


@query("fact_sessions", FACT_SESSIONS)
def fact_sessions(spark, d):
    return M.fact_clickstream_sessions(sessions(spark, d))


AGG_DAILY = f"""SELECT {dk('event_date')} AS date_key, event_date, sessions_started, active_session_count, event_count, distinct_item_count, distinct_category_count, avg_session_duration_seconds FROM (
 SELECT event_date, count(DISTINCT session_id) AS active_session_count, count(*) AS event_count, count(DISTINCT item_id) AS distinct_item_count, count(DISTINCT category) AS distinct_category_count FROM clicks GROUP BY 1) LEFT JOIN (
 SELECT session_start_date AS event_date, count(*) AS sessions_started, avg(session_duration_seconds) AS avg_session_duration_seconds FROM stg_sessions GROUP BY 1) USING (event_date)"""


@query("agg_daily", AGG_DAILY)
def agg_daily(spark, d):
    events = V.clicks(spark, d)
    return M.agg_clickstream_daily(events, M.int_clickstream_sessions(events))


def raw_clicks(spark, d):
    """Events as strings with the lineage of the file that each would come from; some don't parse."""
    e = V.read(spark, d, "events")
    bad = F.col("event_id") % 50
    return e.select(
        F.when(bad == 1, "x").otherwise(F.col("user_id").cast("string")).alias("session_id"), F.when(bad == 2, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("event_timestamp"),
        F.when(bad == 3, "").otherwise(F.get_json_object("props", "$.k")).alias("item_id"), F.when(bad == 4, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"))).alias("category"),
        F.concat(F.lit("clicks/event_date="), F.date_format(F.when(bad == 5, F.col("ts") - F.expr("interval 1 day")).otherwise(F.col("ts")), "yyyy-MM-dd"), F.lit("/part-000.csv")).alias("_source_file_path"),
        F.md5(F.date_format("ts", "yyyy-MM-dd").cast("binary")).alias("_source_file_etag"),
    )


TYPED_SQL = """typed AS (SELECT CASE WHEN event_id % 50 <> 1 THEN user_id END AS session_id, CASE WHEN event_id % 50 <> 2 THEN ts END AS event_timestamp, CASE WHEN event_id % 50 <> 2 THEN CAST(ts AS DATE) END AS event_date,
 CASE WHEN event_id % 50 <> 2 THEN CAST(hour(ts) AS INTEGER) END AS event_hour, CASE WHEN event_id % 50 <> 3 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS item_id,
 CASE WHEN event_id % 50 = 4 THEN '' ELSE event_type END AS category, CAST(ts AS DATE) - CASE WHEN event_id % 50 = 5 THEN 1 ELSE 0 END AS _source_event_date FROM events)"""


@query("typed_clicks", f"WITH {TYPED_SQL} SELECT * FROM typed")
def typed_clicks(spark, d):
    return clickstream.typed_events(raw_clicks(spark, d)).drop("_source_file_path", "_source_file_etag")


@query("dq_conditional_counts", f"""WITH {TYPED_SQL} SELECT unnest(['null_session_id', 'null_event_timestamp', 'null_item_id', 'blank_category', 'wrong_event_date']) AS check_name,
 unnest([count(*) FILTER (session_id IS NULL), count(*) FILTER (event_timestamp IS NULL), count(*) FILTER (item_id IS NULL), count(*) FILTER (category IS NULL OR trim(category) = ''), count(*) FILTER (event_date <> _source_event_date)]) AS failures FROM typed""")
def dq_conditional_counts(spark, d):
    return quality.click_checks(clickstream.typed_events(raw_clicks(spark, d)))


def files_and_processed(spark, d):
    """A file for each user; those of even users are known, every tenth with other contents."""
    e = V.read(spark, d, "events").select("user_id").distinct()
    files = e.select(F.concat(F.lit("u="), "user_id").alias("_source_file_path"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("_source_file_etag"))
    known = e.where("user_id % 2 = 0").select(F.concat(F.lit("u="), "user_id").alias("_source_file_path"), F.md5(F.when(F.col("user_id") % 10 == 0, "old").otherwise(F.col("user_id").cast("string")).cast("binary")).alias("_source_file_etag"))
    return files, known


@query("pending_files", "SELECT DISTINCT 'u=' || user_id AS _source_file_path, md5(CAST(user_id AS VARCHAR)) AS _source_file_etag FROM events WHERE user_id % 2 <> 0 OR user_id % 10 = 0")
def pending_files(spark, d):
    return clickstream.new_sources(*files_and_processed(spark, d))


@query("changed_files", "SELECT DISTINCT 'u=' || user_id AS _source_file_path, md5(CAST(user_id AS VARCHAR)) AS _source_file_etag, md5('old') AS known_etag FROM events WHERE user_id % 10 = 0")
def changed_files(spark, d):
    return clickstream.changed_sources(*files_and_processed(spark, d))


@query("broadcast_new_sources", "SELECT event_id, 'u=' || user_id AS _source_file_path FROM events WHERE user_id % 2 <> 0 OR user_id % 10 = 0")
def broadcast_new_sources(spark, d):
    files, known = files_and_processed(spark, d)
    e = V.read(spark, d, "events").select("event_id", F.concat(F.lit("u="), "user_id").alias("_source_file_path"), F.md5(F.col("user_id").cast("string").cast("binary")).alias("_source_file_etag"))
    return clickstream.of_sources(e, clickstream.new_sources(files, known)).select("event_id", "_source_file_path")


@query("path_fields", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(ts AS DATE) END AS path_date, CASE WHEN event_id % 4 <> 0 THEN 'i' || user_id END AS path_id FROM events")
def path_fields(spark, d):
    path = F.concat(F.lit("/a"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("/event_date="), F.date_format("ts", "yyyy-MM-dd"))).otherwise(""), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("/ingestion_id=i"), "user_id")).otherwise(""), F.lit("/p.csv"))
    return V.read(spark, d, "events").select("event_id", path_date(path).alias("path_date"), path_value(path).alias("path_id"))


@query("invalid_lines", "SELECT CASE event_id % 20 WHEN 0 THEN 'fields' WHEN 1 THEN 'session_id' WHEN 2 THEN 'event_timestamp' WHEN 3 THEN 'item_id' WHEN 4 THEN 'category' END AS reason, count(*) AS lines FROM events GROUP BY 1")
def invalid_lines(spark, d):
    k = F.col("event_id") % 20
    line = F.concat_ws(",", F.when(k == 1, "a1").otherwise(F.col("user_id").cast("string")), F.when(k == 2, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.when(k == 3, "-7").otherwise("12"), F.when(k == 4, " ").otherwise("5"), F.when(k == 0, "extra"))
    return clickstream.valid_lines(V.read(spark, d, "events").select(line.alias("value"))).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query("out_of_order_lines", "SELECT event_id AS position FROM (SELECT event_id, d, max(d) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT event_id, strftime(CASE WHEN event_id % 100 = 7 THEN ts - INTERVAL 3 DAY ELSE ts END, '%Y-%m-%d') AS d FROM events)) WHERE d < m")
def out_of_order_lines(spark, d):
    ts = F.when(F.col("event_id") % 100 == 7, F.col("ts") - F.expr("interval 3 days")).otherwise(F.col("ts"))
    lines = V.read(spark, d, "events").select(F.col("event_id").alias("position"), F.concat(F.lit("1,"), F.date_format(ts, "yyyy-MM-dd"), F.lit("T00:00:00Z,1,1")).alias("value"))
    return clickstream.out_of_order(lines).select("position")


# weather --------------------------------------------------------------------------------------------------------------


def weather_inputs(spark, d):
    """Responses with parallel arrays, one for each user and day, and their metadata."""
    e = V.read(spark, d, "events").withColumn("day", F.to_date("ts"))
    ingestion = F.concat(F.lit("ing-"), "user_id", F.lit("-"), F.date_format("day", "yyyyMMdd")).alias("ingestion_id")
    hours = F.array_sort(F.collect_list(F.struct("event_id", "ts", "value")))
    part = lambda f: F.transform("hours", f)
    groups = e.groupBy("user_id", "day").agg(hours.alias("hours"))
    hourly = F.struct(
        part(lambda h: F.date_format(h["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("time"), part(lambda h: h["value"]).alias("temperature_2m"), part(lambda h: (h["event_id"] % 101).cast("int")).alias("relative_humidity_2m"),
        part(lambda h: (h["event_id"] % 7) / F.lit(10.0)).alias("precipitation"), part(lambda h: h["value"] / 2).alias("wind_speed_10m"), part(lambda h: (h["event_id"] % 4).cast("int")).alias("weather_code"),
    )
    responses = groups.select(ingestion, hourly.alias("hourly"))
    k = F.col("user_id") % 5
    at = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    metadata = e.select("user_id", "day").distinct().select(
        ingestion, F.element_at(F.array(*[F.lit(w[0]) for w in V.WAREHOUSES]), (k + 1).cast("int")).alias("warehouse_id"), at.alias("logical_at"), at.alias("requested_at"), (F.lit(10.5) + k).alias("requested_latitude"), F.lit(106.5).alias("requested_longitude"),
        (F.lit(10.5) + k).alias("response_latitude"), F.lit(106.5).alias("response_longitude"),
        F.struct(F.date_format("day", "yyyy-MM-dd").alias("start_date"), F.date_format("day", "yyyy-MM-dd").alias("end_date")).alias("request_params"),
    )
    return responses, metadata


WEATHER_COLUMNS = "temperature_2m, relative_humidity_2m, precipitation, wind_speed_10m, weather_code"
FORECAST = f"""SELECT warehouse_id, ingestion_id, snapshot_at, retrieved_at, forecast_time, {dk('snapshot_at')} AS snapshot_date_key, {dk('forecast_time')} AS forecast_date_key, CAST(hour(forecast_time) AS INTEGER) AS forecast_hour,
 CAST(round(CAST(epoch_us(forecast_time) - epoch_us(snapshot_at) AS DECIMAL(20,0)) / 3600000000.0, 2) AS DOUBLE) AS forecast_horizon_hours, {WEATHER_COLUMNS},
 CAST(requested_latitude AS DOUBLE) AS requested_latitude, CAST(requested_longitude AS DOUBLE) AS requested_longitude, CAST(response_latitude AS DOUBLE) AS response_latitude, CAST(response_longitude AS DOUBLE) AS response_longitude FROM stg_weather"""


@query("weather_forecast", FORECAST)
def weather_forecast(spark, d):
    return M.fact_weather_forecast_hourly(weather.forecast_silver(*weather_inputs(spark, d)))


def history(spark, d):
    """Hours that several users' windows cover; retrieved at the event's own time."""
    s = weather.forecast_silver(*weather_inputs(spark, d))
    day = F.to_date("snapshot_at")
    return s.select("warehouse_id", F.date_trunc("hour", "forecast_time").alias("weather_time"), "ingestion_id", F.col("forecast_time").alias("retrieved_at"), day.alias("window_start"), day.alias("window_end"), *M.MEASURES, *M.COORDINATES)


@query("weather_historical", f"SELECT warehouse_id, weather_time, {dk('weather_time')} AS weather_date_key, CAST(hour(weather_time) AS INTEGER) AS weather_hour, {WEATHER_COLUMNS}, ingestion_id, retrieved_at FROM stg_resolved")
def weather_historical(spark, d):
    return M.fact_weather_historical_forecast_hourly(weather.resolved(history(spark, d))).drop("window_start", "window_end", *M.COORDINATES)


def history_halves(spark, d):
    h = history(spark, d)
    even = F.pmod(F.crc32(F.col("ingestion_id").cast("binary")), F.lit(2)) == 0
    narrow = lambda x: weather.resolved(x).select("warehouse_id", "weather_time", "retrieved_at", "ingestion_id", "temperature_2m")
    return narrow(h.where(even)), narrow(h.where(~even))


@query("merge_history", "SELECT warehouse_id, weather_time, max(retrieved_at) AS retrieved_at FROM stg_history GROUP BY 1, 2")
def merge_history(spark, d):
    """Later retrievals replace earlier ones."""
    old, new = history_halves(spark, d)
    return R.merge_newer(old, new, ["warehouse_id", "weather_time"], "retrieved_at", "retrieved_at").select("warehouse_id", "weather_time", "retrieved_at")


@query("merge_control", "SELECT DISTINCT ingestion_id, warehouse_id FROM stg_weather")
def merge_control(spark, d):
    """A log that only takes ids that it doesn't have yet, written twice."""
    _, m = weather_inputs(spark, d)
    log = m.select("ingestion_id", "warehouse_id")
    had = log.where("warehouse_id <> 'WH_CT'")
    return had.unionByName(R.insert_new(had, log.unionByName(log), ["ingestion_id"]))


@query("dq_ranges", f"""SELECT unnest(['humidity_out_of_range', 'negative_precipitation', 'negative_wind', 'null_temperature']) AS check_name, unnest([count(*) FILTER (relative_humidity_2m < 0 OR relative_humidity_2m > 100), count(*) FILTER (precipitation < 0), count(*) FILTER (wind_speed_10m < 0), count(*) FILTER (temperature_2m IS NULL)]) AS failures FROM stg_weather""")
def dq_ranges(spark, d):
    return quality.weather_range_checks(weather.forecast_silver(*weather_inputs(spark, d)))


@query("dq_conflicts", "SELECT warehouse_id, weather_time, count(DISTINCT (temperature_2m, relative_humidity_2m, precipitation)) AS versions FROM stg_history GROUP BY 1, 2 HAVING count(DISTINCT (temperature_2m, relative_humidity_2m, precipitation)) > 1")
def dq_conflicts(spark, d):
    return quality.conflicts(history(spark, d), ["warehouse_id", "weather_time"], ["temperature_2m", "relative_humidity_2m", "precipitation"])


@query("dq_completeness", "SELECT ingestion_id, count(*) AS actual_rows, count(DISTINCT weather_time) AS actual_hours, CAST(24 AS INTEGER) AS expected_hours FROM stg_history GROUP BY 1 HAVING count(*) <> 24 OR count(DISTINCT weather_time) <> 24")
def dq_completeness(spark, d):
    return quality.completeness(history(spark, d), ["ingestion_id"], "weather_time", weather.expected_hours())


@query("hist_windows", "SELECT CAST(s AS DATE) AS window_start, CAST(least(s + INTERVAL 29 DAY, last) AS DATE) AS window_end FROM (SELECT unnest(generate_series(first, last, INTERVAL 30 DAY)) AS s, last FROM (SELECT CAST(CAST(min(o_orderdate) AS DATE) AS TIMESTAMP) AS first, CAST(CAST(max(o_orderdate) AS DATE) AS TIMESTAMP) AS last FROM orders))")
def hist_windows(spark, d):
    """Windows of thirty days from the first order to the last."""
    ends = V.read(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    return ends.select(window_rows(F.col("first"), F.col("last")).alias("w")).select("w.*")


@query("request_ids", """SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS request_id
 FROM (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('weather:' || event_type || ':' || user_id || ':' || strftime(ts, '%Y-%m-%d'))) AS h FROM events)""")
def request_ids(spark, d):
    """The id under which each event's request would be known."""
    e = V.read(spark, d, "events")
    return e.select("event_id", request_id_of(F.lit("weather"), F.col("event_type"), F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("request_id"))


# incremental ----------------------------------------------------------------------------------------------------------

CURSOR = ("o_orderdate", "o_orderkey")
BATCH = 5000


def nth_batch(n: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = V.read(spark, d, "orders").select(*CURSOR, "o_totalprice")
        top = R.upper_watermark(rows, CURSOR).first()
        lower = None
        for _ in range(n - 1):  # the cursor alone reaches the driver
            last = R.upper_watermark(R.keyset_batch(rows, CURSOR, lower, tuple(top), BATCH), CURSOR).first()
            if last is None:
                break
            lower = tuple(last)
        return R.keyset_batch(rows, CURSOR, lower, tuple(top), BATCH)

    return run


for _n in (1, 2, 3):
    query(f"keyset_batch_{_n}", f"SELECT o_orderdate, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) BETWEEN {(_n - 1) * BATCH + 1} AND {_n * BATCH}")(nth_batch(_n))


@query("upper_watermark", "SELECT o_orderdate, o_orderkey FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 1")
def upper_watermark(spark, d):
    return R.upper_watermark(V.read(spark, d, "orders"), CURSOR)


# quality --------------------------------------------------------------------------------------------------------------


@query("dq_duplicates", "SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_duplicates(spark, d):
    return quality.duplicates(V.item_versions(spark, d), V.ITEM_KEY)


NULLABLE = ("order_id", "customer_id", "order_approved_at", "order_delivered_customer_date", "item_line_count", "payment_count", "delivery_days")


@query("dq_nulls", "SELECT unnest([" + ", ".join(f"'not_null_{c}'" for c in NULLABLE) + "]) AS check_name, unnest([" + ", ".join(f"count(*) FILTER ({c} IS NULL)" for c in NULLABLE) + "]) AS failures FROM stg_enriched")
def dq_nulls(spark, d):
    return quality.not_null(int_orders_enriched(spark, d), NULLABLE)


RELATIONS = (("order_id", "stg_orders", "order_id"), ("customer_id", "(SELECT c_custkey AS customer_id FROM customer WHERE c_custkey % 100 <> 0)", "customer_id"), ("seller_id", "(SELECT s_suppkey AS seller_id FROM supplier)", "seller_id"), ("product_id", "(SELECT p_partkey AS product_id FROM part WHERE p_partkey % 10 <> 0)", "product_id"))


@query("dq_relationships", " UNION ALL ".join(f"SELECT 'relationship_items_{c}' AS check_name, count(*) AS failures FROM stg_fact_items i WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{k} = i.{c})" for c, p, k in RELATIONS))
def dq_relationships(spark, d):
    """Foreign keys of order items; some parents are left out so that there is something to find."""
    orders = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"))
    parents = {"order_id": orders, "customer_id": V.stg_customers(spark, d).where("customer_id % 100 <> 0"), "seller_id": V.stg_sellers(spark, d), "product_id": V.stg_products(spark, d).where("product_id % 10 <> 0")}
    return quality.relationships(fact_order_items(spark, d), [(c, p, c, f"items_{c}") for c, p in parents.items()])


@query("dq_date_relationships", f"WITH d AS (SELECT CAST(strftime(x, '%Y%m%d') AS INTEGER) AS k FROM (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS x)), o AS (SELECT {dk('o_orderdate')} AS k FROM orders) SELECT 'relationship_orders_purchase_date_key' AS check_name, count(*) AS failures FROM o WHERE k NOT IN (SELECT k FROM d)")
def dq_date_relationships(spark, d):
    from datetime import date

    keys = V.read(spark, d, "orders").select(M.date_key("o_orderdate").alias("purchase_date_key"))
    return quality.relationship(keys, "purchase_date_key", F.broadcast(M.dim_date(spark, date(1996, 1, 1), date(1999, 12, 31))), "date_key", "orders_purchase_date_key")


@query("dq_unique_keys", "SELECT 'unique_orders' AS check_name, count(*) AS failures FROM (SELECT order_id FROM stg_orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unique_items', count(*) FROM (SELECT order_id FROM stg_order_items GROUP BY order_id, order_item_id HAVING count(*) > 1) UNION ALL SELECT 'unique_versions', count(*) FROM (SELECT order_id FROM stg_versions GROUP BY order_id, order_item_id HAVING count(*) > 1)")
def dq_unique_keys(spark, d):
    return quality.all_checks(quality.unique(V.stg_orders(spark, d), ["order_id"], "orders"), quality.unique(V.stg_order_items(spark, d), V.ITEM_KEY, "items"), quality.unique(V.item_versions(spark, d), V.ITEM_KEY, "versions"))


@query("dq_reconcile", "SELECT order_id, CAST(total AS DOUBLE) AS total, CAST(part_sum AS DOUBLE) AS part_sum FROM (SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(12,2)) AS total, coalesce((SELECT sum(payment_value) FROM stg_order_payments p WHERE p.order_id = o_orderkey), 0) AS part_sum FROM orders) WHERE abs(total - part_sum) > 0.01")
def dq_reconcile(spark, d):
    totals = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").cast("decimal(12,2)").alias("total_price"))
    return quality.reconciled(totals, V.stg_order_payments(V.stg_order_items(spark, d)), "order_id", "total_price", "payment_value")


TIME_CHECKS = {"pending_with_approval": "order_status = 'P' AND order_approved_at IS NOT NULL", "open_with_delivery": "order_status <> 'F' AND order_delivered_customer_date IS NOT NULL", "finished_without_delivery": "order_status = 'F' AND order_delivered_customer_date IS NULL", "approved_before_purchase": "order_approved_at < order_purchase_timestamp", "carrier_before_approval": "order_delivered_carrier_date < order_approved_at", "delivered_before_carrier": "order_delivered_customer_date < order_delivered_carrier_date", "delivered_before_purchase": "order_delivered_customer_date < order_purchase_timestamp", "unknown_status": "order_status NOT IN ('F', 'O', 'P')"}


@query("dq_time_matrix", f"SELECT unnest({list(TIME_CHECKS)}) AS check_name, unnest([{', '.join(f'count(*) FILTER ({c})' for c in TIME_CHECKS.values())}]) AS failures FROM stg_orders")
def dq_time_matrix(spark, d):
    return quality.order_time_checks(V.stg_orders(spark, d), STATUSES)


@query("dq_orders_without_items", "SELECT o_orderkey AS order_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dq_orders_without_items(spark, d):
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"))
    return o.join(V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id")), "order_id", "left_anti")


RULES = {
    "order_without_lines": "lines IS NULL", "not_one_payment": "coalesce(payments, 0) <> 1", "other_warehouse": "lines IS NOT NULL AND (warehouse_id IS DISTINCT FROM fw OR warehouse_id IS DISTINCT FROM lw)",
    "status_not_listed": "order_status NOT IN ('F', 'O')", "paid_other_amount": "abs(coalesce(paid, 0) - coalesce(due, 0)) > 0.01",
}


@query("dq_order_rules", f"""SELECT unnest({list(RULES)}) AS check_name, unnest([{', '.join(f'count(*) FILTER ({c})' for c in RULES.values())}]) AS failures FROM stg_orders
 LEFT JOIN (SELECT order_id, count(*) AS lines, sum(price * quantity + freight_value) AS due, min(warehouse_id) AS fw, max(warehouse_id) AS lw FROM stg_order_items GROUP BY 1) USING (order_id)
 LEFT JOIN (SELECT order_id, count(*) AS payments, sum(payment_value) AS paid FROM stg_order_payments GROUP BY 1) USING (order_id)""")
def dq_order_rules(spark, d):
    return quality.order_rules(*enriched_inputs(spark, d), STATUSES)


@query("bronze_coverage", "SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS different_keys, updated_at AS top_updated_at, order_id AS top_order_id, order_item_id AS top_order_item_id FROM stg_versions ORDER BY updated_at DESC, order_id DESC, order_item_id DESC LIMIT 1")
def bronze_coverage(spark, d):
    return quality.coverage(V.item_versions(spark, d), V.ITEM_KEY, ("updated_at", *V.ITEM_KEY))


@query("due_orders", "SELECT order_id, updated_at FROM stg_orders WHERE (order_status = 'O' AND updated_at <= TIMESTAMP '2001-06-01' - INTERVAL 2 MINUTE) OR (order_status = 'P' AND updated_at <= TIMESTAMP '1999-01-01' - INTERVAL 1 DAY)")
def due_orders(spark, d):
    """Orders old enough for their next step, by the age that their status needs."""
    o = V.stg_orders(spark, d)
    at = lambda t, age: F.lit(t).cast("timestamp_ntz") - F.expr(age)
    old_open = (F.col("order_status") == "O") & (F.col("updated_at") <= at("2001-06-01", "interval 2 minutes"))
    old_pending = (F.col("order_status") == "P") & (F.col("updated_at") <= at("1999-01-01", "interval 1 day"))
    return o.where(old_open | old_pending).select("order_id", "updated_at")


@query("approved_orders_semi", "SELECT order_id, order_status FROM stg_orders WHERE order_id IN (SELECT order_id FROM stg_order_payments WHERE payment_type = 'R')")
def approved_orders_semi(spark, d):
    """Orders with a payment of a kind."""
    paid = V.stg_order_payments(V.stg_order_items(spark, d)).where("payment_type = 'R'").select("order_id")
    return V.stg_orders(spark, d).join(paid, "order_id", "left_semi").select("order_id", "order_status")


@query("star_orders", f"SELECT year(order_purchase_timestamp) AS year, r_name AS state_code, region, CAST(sum(1) AS BIGINT) AS orders, CAST(sum(CAST(total_payment_value AS DECIMAL(20,2))) AS DOUBLE) AS revenue FROM stg_enriched LEFT JOIN customer ON customer_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (VALUES {', '.join(map(repr, V.WAREHOUSES))}) w(warehouse_id, city, region) ON order_warehouse_id = w.warehouse_id GROUP BY 1, 2, 3".replace("year(order_purchase_timestamp)", "CAST(year(order_purchase_timestamp) AS INTEGER)"))
def star_orders(spark, d):
    """The order fact with its customer and warehouse dimensions."""
    fact = fact_orders(spark, d).withColumn("year", F.year("order_purchase_timestamp"))
    w = F.broadcast(dim_warehouses(spark, d).select(F.col("warehouse_id").alias("order_warehouse_id"), F.col("region")))  # five rows
    joined = fact.join(dim_customers(spark, d).select("customer_id", "state_code"), "customer_id", "left").join(w, "order_warehouse_id", "left")
    return joined.groupBy("year", "state_code", "region").agg(F.sum("order_count").alias("orders"), F.sum("total_payment_value").alias("revenue"))


# inventory ------------------------------------------------------------------------------------------------------------


def stock(spark, d):
    k = F.col("p_partkey")
    ids = F.array(*[F.lit(w[0]) for w in V.WAREHOUSES])
    at = F.array_distinct(F.concat(F.array(k % 5, (k + 1) % 5), F.when(k % 2 == 0, F.array((k + 3) % 5)).otherwise(F.array().cast("array<bigint>"))))
    rows = V.read(spark, d, "part").select(k.alias("product_id"), F.explode(at).alias("k"))
    return rows.select(F.element_at(ids, (F.col("k") + 1).cast("int")).alias("warehouse_id"), "product_id", ((F.col("product_id") * 7 + F.col("k") * 13) % 500).cast("int").alias("quantity_available"))


@query("inventory_distribution", "SELECT warehouse_id, count(*) AS product_count, CAST(sum(quantity_available) AS BIGINT) AS total_quantity FROM stg_inventory GROUP BY 1")
def inventory_distribution(spark, d):
    return inventory.distribution(stock(spark, d))


@query("restock", "SELECT warehouse_id, product_id, CAST(quantity_available + coalesce(back, 0) AS INTEGER) AS quantity_available FROM stg_inventory LEFT JOIN (SELECT warehouse_id, product_id, sum(quantity) AS back FROM stg_versions WHERE return_flag = 'R' GROUP BY 1, 2) USING (warehouse_id, product_id)")
def restock(spark, d):
    return inventory.restocked(stock(spark, d), V.item_versions(spark, d).where("return_flag = 'R'"))


@query("withdraw", "SELECT warehouse_id, product_id, CAST(CASE WHEN quantity_available >= coalesce(need, 0) THEN quantity_available - coalesce(need, 0) ELSE quantity_available END AS INTEGER) AS quantity_available, quantity_available < coalesce(need, 0) AS refused FROM stg_inventory LEFT JOIN (SELECT warehouse_id, product_id, sum(quantity) AS need FROM stg_versions WHERE return_flag = 'N' GROUP BY 1, 2) USING (warehouse_id, product_id)")
def withdraw(spark, d):
    return inventory.withdrawn(stock(spark, d), V.item_versions(spark, d).where("return_flag = 'N'"))


@query("dq_inventory", "SELECT 'too_few_warehouses' AS check_name, count(*) FILTER (n < 2) AS failures FROM (SELECT product_id, count(*) AS n FROM stg_inventory GROUP BY 1) UNION ALL SELECT 'too_many_warehouses', count(*) FILTER (n > 3) FROM (SELECT product_id, count(*) AS n FROM stg_inventory GROUP BY 1) UNION ALL SELECT 'negative_quantity', count(*) FILTER (quantity_available < 0) FROM stg_inventory UNION ALL SELECT 'relationship_inventory_product', 0 UNION ALL SELECT 'relationship_inventory_warehouse', 0")
def dq_inventory(spark, d):
    return inventory.rules(stock(spark, d), V.stg_products(spark, d), V.stg_warehouses(spark))


@query("status_funnel", "SELECT CASE WHEN (o_orderkey * 7919) % 100 < 90 THEN 'approved' WHEN (o_orderkey * 7919) % 100 < 98 THEN 'canceled' ELSE 'unavailable' END AS next_status, count(*) AS orders FROM orders GROUP BY 1")
def status_funnel(spark, d):
    from quern.simulator import next_of_created

    draw = (F.col("o_orderkey") * 7919) % 100
    return V.read(spark, d, "orders").select(next_of_created(draw).alias("next_status")).groupBy("next_status").agg(F.count(F.lit(1)).alias("orders"))


SIMULATED = """sim AS (SELECT o_orderkey AS order_id, ['created', 'approved', 'processing', 'shipped', 'delivered'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS order_status, o_orderdate AS updated_at, (o_orderkey * 7919) % 100 AS draw FROM orders WHERE o_orderkey % 3 <> 0),
 picked AS (SELECT *, CASE order_status WHEN 'created' THEN CASE WHEN draw < 90 THEN 'approved' WHEN draw < 98 THEN 'canceled' ELSE 'unavailable' END WHEN 'approved' THEN 'processing' WHEN 'processing' THEN 'shipped' ELSE 'delivered' END AS new_status FROM sim
  WHERE updated_at <= TIMESTAMP '1996-02-01' - CASE order_status WHEN 'created' THEN INTERVAL 2 MINUTE WHEN 'approved' THEN INTERVAL 15 MINUTE WHEN 'processing' THEN INTERVAL 2 HOUR WHEN 'shipped' THEN INTERVAL 1 DAY ELSE INTERVAL 1000 YEAR END ORDER BY updated_at, order_id LIMIT 1000)"""


def simulated(spark, d):
    """Orders in every status, two of three from the simulator."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("created", "approved", "processing", "shipped", "delivered"))), (k % 5 + 1).cast("int"))
    none = F.lit(None).cast("timestamp_ntz")
    return V.read(spark, d, "orders").select(k.alias("order_id"), status.alias("order_status"), F.col("o_orderdate").alias("updated_at"), F.when(k % 3 != 0, "simulator").otherwise("seed").alias("source_system"), none.alias("order_approved_at"), none.alias("order_delivered_carrier_date"), none.alias("order_delivered_customer_date"))


AT, CYCLE = "1996-02-01", 1000


@query("status_cycle", f"""WITH {SIMULATED} SELECT order_id, new_status AS order_status, order_status AS old_status, TIMESTAMP '{AT}' AS updated_at, CASE WHEN new_status = 'approved' THEN TIMESTAMP '{AT}' END AS order_approved_at,
 CASE WHEN new_status = 'shipped' THEN TIMESTAMP '{AT}' END AS order_delivered_carrier_date, CASE WHEN new_status = 'delivered' THEN TIMESTAMP '{AT}' END AS order_delivered_customer_date FROM picked""")
def status_cycle(spark, d):
    """The orders that a cycle of the simulator moves: the oldest that are due."""
    from quern.simulator import cycle

    return cycle(simulated(spark, d), AT, CYCLE, draw=(F.col("order_id") * 7919) % 100).drop("source_system")


@query("status_transitions", f"WITH {SIMULATED} SELECT order_status AS old_status, new_status AS order_status, count(*) AS orders FROM picked GROUP BY 1, 2")
def status_transitions(spark, d):
    from quern.simulator import transitions

    return transitions(status_cycle(spark, d))


@query("status_restock", f"SELECT warehouse_id, product_id, CAST(quantity_available + coalesce(back, 0) AS INTEGER) AS quantity_available FROM stg_inventory LEFT JOIN (SELECT warehouse_id, product_id, sum(quantity) AS back FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, ['WH_HCM', 'WH_HN', 'WH_DN', 'WH_CT', 'WH_HP'][CAST(l_partkey % 5 AS INTEGER) + 1] AS warehouse_id, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem) WHERE order_id IN (WITH {SIMULATED} SELECT order_id FROM picked WHERE new_status IN ('canceled', 'unavailable')) GROUP BY 1, 2) USING (warehouse_id, product_id)")
def status_restock(spark, d):
    """Stock with the pieces of orders that a cycle has called off."""
    from quern.simulator import returned_stock

    home = F.element_at(F.array(*[F.lit(w[0]) for w in V.WAREHOUSES]), (F.col("l_partkey") % 5 + 1).cast("int"))
    items = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), home.alias("warehouse_id"), F.col("l_quantity").cast("int").alias("quantity"))
    return returned_stock(stock(spark, d), status_cycle(spark, d), items)


@query("status_applied", f"WITH {SIMULATED} SELECT o_orderkey AS order_id, coalesce(new_status, ['created', 'approved', 'processing', 'shipped', 'delivered'][CAST(o_orderkey % 5 AS INTEGER) + 1]) AS order_status FROM orders LEFT JOIN picked ON order_id = o_orderkey")
def status_applied(spark, d):
    """All orders after a cycle."""
    from quern.simulator import applied

    return applied(simulated(spark, d), status_cycle(spark, d)).select("order_id", "order_status")


# measures -------------------------------------------------------------------------------------------------------------


@query("kpi_orders", "SELECT CAST(CAST(sum(CAST(total_payment_value AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS DOUBLE) AS total_revenue, count(*) AS total_orders, count(DISTINCT customer_id) AS total_customers, CAST(sum(CAST(total_payment_value AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS average_order_value, count(*) FILTER (is_delivered) AS delivered_orders, CAST(count(*) FILTER (is_delivered) AS DOUBLE) / count(*) AS delivered_rate, count(*) FILTER (order_status = 'P') AS pending_orders, CAST(count(*) FILTER (order_status = 'P') AS DOUBLE) / count(*) AS pending_rate, CAST(sum(delivery_days) AS DOUBLE) / count(delivery_days) AS avg_delivery_days FROM stg_enriched")
def kpi_orders(spark, d):
    return K.orders_summary(fact_orders(spark, d), ("P",), "pending")


@query("kpi_items", "SELECT CAST(sum(quantity) AS BIGINT) AS items_sold, CAST(sum(merchandise_value) AS DOUBLE) AS merchandise_value, CAST(sum(freight_value) AS DOUBLE) AS freight_value, CAST(sum(item_total_value) AS DOUBLE) AS order_item_value, count(DISTINCT order_id) AS item_orders, count(DISTINCT product_id) AS distinct_products, count(DISTINCT seller_id) AS active_sellers, round(avg(CAST(unit_price AS DOUBLE)), 6) AS avg_price_per_item, CAST(sum(freight_value) AS DOUBLE) / CAST(sum(merchandise_value) + sum(freight_value) AS DOUBLE) AS freight_share FROM stg_fact_items")
def kpi_items(spark, d):
    return K.items_summary(fact_order_items(spark, d)).withColumn("avg_price_per_item", F.round("avg_price_per_item", 6))


@query("kpi_sessions", "SELECT count(*) AS sessions, CAST(sum(event_count) AS BIGINT) AS events, CAST(sum(event_count) AS DOUBLE) / count(*) AS events_per_session, CAST(sum(session_duration_seconds) AS DOUBLE) / count(*) AS avg_session_duration_seconds, count(*) FILTER (session_start_date <> session_end_date) AS cross_date_sessions, CAST(count(*) FILTER (session_start_date <> session_end_date) AS DOUBLE) / count(*) AS cross_date_rate FROM stg_sessions")
def kpi_sessions(spark, d):
    return K.sessions_summary(fact_sessions(spark, d))


@query("kpi_daily", "SELECT CAST(sum(a) AS DOUBLE) / count(*) AS avg_daily_active_sessions, CAST(sum(i) AS DOUBLE) / count(*) AS avg_daily_items FROM (SELECT count(DISTINCT session_id) AS a, count(DISTINCT item_id) AS i FROM clicks GROUP BY event_date)")
def kpi_daily(spark, d):
    return K.daily_summary(agg_daily(spark, d))


WEATHER_KPI = "SELECT warehouse_id, round(avg(temperature_2m), 6) AS avg_temperature, round(avg(relative_humidity_2m), 6) AS avg_humidity, round(avg(wind_speed_10m), 6) AS avg_wind, round(sum(precipitation), 6) AS total_precipitation FROM {} GROUP BY 1"


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("kpi_weather_history", WEATHER_KPI.format("stg_resolved"))
def kpi_weather_history(spark, d):
    return rounded(K.weather_summary(weather_historical(spark, d)))


@query("kpi_weather_forecast", WEATHER_KPI.format("(SELECT * FROM stg_weather WHERE (warehouse_id, snapshot_at) IN (SELECT (warehouse_id, max(snapshot_at)) FROM stg_weather GROUP BY warehouse_id))"))
def kpi_weather_forecast(spark, d):
    return rounded(K.weather_summary(K.latest_snapshot(weather_forecast(spark, d))))


REVENUE = "count(*) AS orders, CAST(sum(CAST(total_payment_value AS DECIMAL(20,2))) AS DOUBLE) AS revenue"


@query("kpi_monthly", f"SELECT CASE WHEN y >= 2014 THEN y END AS year, CASE WHEN y >= 2014 THEN m END AS month, orders, revenue FROM (SELECT CAST(year(p) AS INTEGER) AS y, CAST(month(p) AS INTEGER) AS m, {REVENUE} FROM (SELECT order_purchase_timestamp + INTERVAL 20 YEAR AS p, total_payment_value FROM stg_enriched) GROUP BY 1, 2)")
def kpi_monthly(spark, d):
    """Purchases moved into the calendar's years."""
    moved = fact_orders(spark, d).withColumn("purchase_date_key", F.col("purchase_date_key") + 200_000)
    return K.monthly_trend(moved, M.dim_date(spark))


@query("kpi_state", f"SELECT r_name AS state_code, {REVENUE} FROM stg_enriched LEFT JOIN customer ON customer_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def kpi_state(spark, d):
    return K.by_state(fact_orders(spark, d), dim_customers(spark, d))


@query("kpi_status", f"SELECT order_status, {REVENUE} FROM stg_enriched GROUP BY 1")
def kpi_status(spark, d):
    return K.by_column(fact_orders(spark, d), "order_status")


@query("kpi_warehouse", f"SELECT order_warehouse_id, {REVENUE} FROM stg_enriched GROUP BY 1")
def kpi_warehouse(spark, d):
    return K.by_column(fact_orders(spark, d), "order_warehouse_id")


@query("kpi_category", "SELECT split_part(p_type, ' ', 1) AS category_name, CAST(sum(quantity) AS BIGINT) AS items_sold, CAST(sum(merchandise_value) AS DOUBLE) AS merchandise_value FROM stg_fact_items LEFT JOIN part ON product_id = p_partkey GROUP BY 1")
def kpi_category(spark, d):
    return K.by_category(fact_order_items(spark, d), dim_products(spark, d))


@query("kpi_top_products", "SELECT product_id, CAST(sum(merchandise_value) AS DOUBLE) AS merchandise_value, CAST(sum(quantity) AS BIGINT) AS items_sold FROM stg_fact_items GROUP BY 1 ORDER BY sum(merchandise_value) DESC, 1 LIMIT 10")
def kpi_top_products(spark, d):
    return K.top_products(fact_order_items(spark, d))


# streaming ------------------------------------------------------------------------------------------------------------


@query("stream_ingest", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS event_count FROM events GROUP BY 1")
def stream_ingest(spark, d):
    from quern.streaming.ingest import daily_counts_of_stream

    return daily_counts_of_stream(spark, d)
