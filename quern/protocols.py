"""Queries that run a whole protocol in the shared work folder (ingestion, staging, recovery, serving) and return what it leaves there."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import views as V
from quern.catalogue import AGG_DAILY, FACT_ORDERS, query
from quern.contracts import CONTRACTS, contract_of
from quern.functions.scalar import windows
from quern.plans import marts as M
from quern.plans import pipelines as P
from quern.plans.daily import DailyStates
from quern.plans.registry import TABLE, Model, Registry
from quern.sources.files import ingest_files, split_by_date, upload_landing
from quern.sources.incremental import METHOD, Ingestion, bronze_checks, type_checks
from quern.sources.places import work_dir
from quern.sources.readers import discover
from quern.sources.seed import SEED_FILES, load_seed, null_checks, row_count_checks
from quern.sources.weather_units import PLACES, ingest_forecasts, ingest_history
from quern.storage import Files, SnapshotTable, load_staging
from quern.streaming.keyset import ingest_keyset

T0 = datetime(2026, 8, 1)
SOME = 5000


class Crash(Exception):
    pass


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own, which goes when the driver ends."""
    path = f"{work_dir(spark)}/quern-protocols/{name}-{uuid.uuid4().hex}"
    files = Files(spark)
    files.fs(path).deleteOnExit(files.path(path))
    return path


def expect(got: object, want: object) -> None:
    """A step of a protocol that did something else than it should is an error."""
    if got != want:
        raise RuntimeError(f"{got} instead of {want}")


def crash_once(step: str) -> Callable[[str], None]:
    """Fails when a step is reached for the second time, and only then."""
    seen: list[str] = []

    def fail(at: str) -> None:
        seen.append(at)
        if at == step and seen.count(at) == 2:
            raise Crash(at)

    return fail


def orders_source(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Orders as the source system has them, changed when their date says."""
    o = V.read(spark, d, "orders") if rows is None else rows
    return contract_of("orders").select(o.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.when(F.col("o_orderkey") % 9 != 0, V.warehouse_of(F.col("o_orderkey"))).alias("warehouse_id"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp"), *[F.lit(None).alias(c) for c in ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")],
        F.lit("seed").alias("source_system"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
    ))


ORDER_SQL = "CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS order_status, o_orderdate AS updated_at"


@query("ingest_replay", f"SELECT {ORDER_SQL}, 'orders' AS _source_table, 'timestamp_incremental' AS _ingestion_method, TIMESTAMP '{T0}' AS _ingested_at, o_orderdate AS _source_updated_at FROM orders")
def ingest_replay(spark, d):
    """Raw rows after a crash before the first batch is done and its recovery, with orders that came in between: every order once."""
    place, c = folder(spark, "ingest"), contract_of("orders")
    metadata = {"_source_table": F.lit("orders"), "_ingestion_method": F.lit(METHOD), "_source_updated_at": F.col(c.watermark)}
    go = lambda fail: ingest_keyset(spark, c, f"{place}/source", f"{place}/bronze", f"{place}/checkpoint", "r", metadata, F.lit(T0), fail=fail)
    late = F.col("updated_at") >= F.lit("1996-01-01").cast("timestamp_ntz")
    source = orders_source(spark, d)
    source.where(~late).write.parquet(f"{place}/source")
    stop = crash_once("commit")
    stop("commit")
    try:
        go(stop)
    except Exception as e:  # the stream says what has ended it
        if "Crash" not in str(e):
            raise
    source.where(late).write.mode("append").parquet(f"{place}/source")
    go(lambda step: None)
    return P.read_bronze(spark, c, f"{place}/bronze").select("order_id", "customer_id", "order_status", "updated_at", "_source_table", "_ingestion_method", "_ingested_at", "_source_updated_at")


BRONZE_CHECKS = (
    "wrong_path", "wrong_date", "wrong_source_table", "wrong_ingestion_id", "wrong_method", "null_ingested_at", "null_source_updated_at", "other_updated_at", "null_key", "no_rows", "missing_keys", "top_is_not_source_upper",
    "checkpoint_is_not_source_upper", "batch_pending",
)


@query("dq_bronze_end_to_end", f"SELECT c AS check_name, CASE c WHEN 'missing_keys' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 40 = 0) ELSE 0 END AS failures FROM (SELECT unnest({list(BRONZE_CHECKS)}) AS c)")
def dq_bronze_end_to_end(spark, d):
    """The raw layer against its source and control state, the source holding more keys than were taken in."""
    place = folder(spark, "bronze")
    have = lambda: orders_source(spark, d, V.read(spark, d, "orders").where("o_orderkey % 40 <> 0"))
    Ingestion(spark, contract_of("orders"), have, f"{place}/bronze", f"{place}/state", 10**6, now=lambda: T0).run("all")
    late = orders_source(spark, d, V.read(spark, d, "orders").where("o_orderkey % 40 = 0")).withColumn("updated_at", F.lit("1990-01-01").cast("timestamp_ntz"))
    return bronze_checks(spark, contract_of("orders"), have().unionByName(late), f"{place}/bronze", f"{place}/state")


TYPE_COLUMNS = tuple(contract_of("orders").bronze_schema().names)


WRONG_TYPES = ("order_id", "updated_at", "warehouse_id", "customer_id")


@query("dq_bronze_types", f"SELECT c AS check_name, CASE WHEN c IN ({', '.join(repr(f'type_{c}') for c in WRONG_TYPES)}) THEN (SELECT count(DISTINCT o_orderstatus) FROM orders) ELSE 0 END AS failures FROM (SELECT unnest([{', '.join(repr(f'type_{c}') for c in TYPE_COLUMNS)}]) AS c)")
def dq_bronze_types(spark, d):
    """Types in the files themselves: right ones, with strings where a column has only nulls, and a file for each status with a number, a text, a date and nothing where something else should be."""
    place, c = folder(spark, "types"), contract_of("orders")
    nulls = lambda: orders_source(spark, d).withColumn("warehouse_id", F.lit(None).cast("string"))
    Ingestion(spark, c, nulls, f"{place}/bronze", f"{place}/state", 10**6, now=lambda: T0).run("all")
    raw = spark.read.schema(c.bronze_schema()).parquet(*[f"{place}/bronze/orders/ingestion_date={T0.date()}/{x}" for x in Files(spark).names(f"{place}/bronze/orders/ingestion_date={T0.date()}")])
    wrong = raw.withColumns({"order_id": F.col("order_id").cast("long"), "updated_at": F.col("updated_at").cast("string"), "customer_id": F.col("order_purchase_timestamp").cast("date")}).drop("warehouse_id")
    for s in sorted(r[0] for r in raw.select("order_status").dropna().distinct().collect()):  # a file for each; one folder a write, so that its task needs no sort
        wrong.where(F.col("order_status") == s).repartition(1).write.parquet(f"{place}/bronze/orders/ingestion_date={T0.date()}/extraction_id=wrong_{s}")
    return type_checks(spark, c, f"{place}/bronze")


CHANGED = "CASE WHEN o_orderkey % 10 = 0 THEN 'C' ELSE o_orderstatus END"


def two_days(spark: SparkSession, d: str, place: str) -> None:
    """Orders taken in and cleaned on one day; every tenth changed, some taken in late, on the next."""
    c = contract_of("orders")
    old = orders_source(spark, d, V.read(spark, d, "orders").where("o_orderkey % 7 <> 0"))
    late = orders_source(spark, d, V.read(spark, d, "orders").where("o_orderkey % 10 = 0 or o_orderkey % 7 = 0")).withColumn("updated_at", F.lit("2002-01-01").cast("timestamp_ntz"))
    late = late.withColumn("order_status", F.when(F.col("order_id").cast("long") % 10 == 0, "C").otherwise(F.col("order_status")))
    for day, source in ((T0, old), (T0 + timedelta(days=1), old.unionByName(late))):
        Ingestion(spark, c, lambda source=source: source, f"{place}/bronze", f"{place}/state", 10**6, now=lambda day=day: day).run(f"day{day.day}")
        P.silver_table(spark, "orders", f"{place}/bronze", f"{place}/silver", buckets=4)


SILVER_SQL = f"SELECT CAST(o_orderkey AS VARCHAR) AS order_id, {CHANGED} AS order_status, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 7 = 0 THEN TIMESTAMP '2002-01-01' ELSE o_orderdate END AS updated_at, CAST(o_orderdate AS DATE) AS order_purchase_date FROM orders"


@query("silver_merge", SILVER_SQL)
def silver_merge(spark, d):
    """The cleaned table after two days of changes."""
    place = folder(spark, "silver")
    two_days(spark, d, place)
    return P.silver_rows(spark, "orders", f"{place}/silver").select("order_id", "order_status", "updated_at", "order_purchase_date")


@query("staging_load", SILVER_SQL)
def staging_load(spark, d):
    """The cleaned table, staged, checked and promoted in one step."""
    place = folder(spark, "staging")
    two_days(spark, d, place)
    expect(P.serve_table(spark, "orders", f"{place}/silver", f"{place}/staging"), "LOADED")
    target = SnapshotTable(spark, f"{place}/staging/orders")
    expect(load_staging(P.silver_rows(spark, "orders", f"{place}/silver"), target, ["order_id"], skip_same=True), "NO_OP")
    return target.read().select("order_id", "order_status", "updated_at", "order_purchase_date")


@query("staging_reload", "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def staging_reload(spark, d):
    """Served orders of which one row changes: the count is the same, the fingerprint isn't, so it is loaded; the same rows again are not."""
    target = SnapshotTable(spark, f"{folder(spark, 'reload')}/orders")
    rows = V.read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    last = rows.agg(F.max("o_orderkey").alias("top"))
    other = rows.join(F.broadcast(last)).withColumn("o_orderstatus", F.when(F.col("o_orderkey") == F.col("top"), "X").otherwise(F.col("o_orderstatus"))).drop("top")
    expect([load_staging(x, target, ["o_orderkey"], skip_same=True) for x in (rows, rows.orderBy("o_totalprice"), other, other)], ["LOADED", "NO_OP", "LOADED", "NO_OP"])
    return target.read()


# files ----------------------------------------------------------------------------------------------------------------


def click_lines(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    return e.select(
        F.concat_ws(",", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), (F.col("event_id") % 1000).cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("value"),
        F.to_date("ts").alias("event_date"),
    )


def landed(spark: SparkSession, d: str, place: str) -> str:
    """A file of click lines for each date."""
    click_lines(spark, d).repartition("event_date").write.partitionBy("event_date").option("compression", "none").format("text").save(f"{place}/lines")
    files = Files(spark)
    for name in files.names(f"{place}/lines"):  # a folder a date
        for part in files.names(f"{place}/lines/{name}"):
            if part.endswith(".txt"):
                files.copy(f"{place}/lines/{name}/{part}", f"{place}/source/{name}/part-000.csv")
    return f"{place}/source"


DATES_SQL = "SELECT CAST(ts AS DATE) AS event_date, count(*) AS n FROM events GROUP BY 1"


@query("landing_upload", "SELECT unnest(['uploaded', 'skipped', 'skipped_again']) AS outcome, unnest([(SELECT count(DISTINCT CAST(ts AS DATE)) FROM events), 0, (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events)]) AS files")
def landing_upload(spark, d):
    """Files uploaded with their sizes verified, then skipped."""
    place = folder(spark, "upload")
    source = landed(spark, d, place)
    first, again = (upload_landing(spark, source, f"{place}/landing") for _ in range(2))
    return spark.createDataFrame([("uploaded", first["uploaded"]), ("skipped", first["skipped"]), ("skipped_again", again["skipped"])], "outcome string, files long")


@query("discovered_files", "SELECT 'event_date=' || strftime(CAST(ts AS DATE), '%Y-%m-%d') || '/part-000.csv' AS relative_path, CAST(sum(length(CAST(user_id AS VARCHAR)) + length(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')) + length(CAST(event_id % 1000 AS VARCHAR)) + length(event_type) + 6) AS BIGINT) AS size FROM events GROUP BY 1")
def discovered_files(spark, d):
    """Files by path with their sizes; the known ones aren't read again."""
    source = landed(spark, d, folder(spark, "discover"))
    first = discover(spark, source)
    again = discover(spark, source, known=first.where("relative_path like '%5/%'"))
    return again.join(first.select("relative_path", "etag"), ["relative_path", "etag"]).select("relative_path", "size")


@query("split_dates", DATES_SQL)
def split_dates(spark, d):
    """Raw lines by date."""
    place = folder(spark, "split")
    click_lines(spark, d).select("value").write.text(f"{place}/raw")
    split_by_date(spark, f"{place}/raw", f"{place}/dates", chunk_lines=SOME)
    return spark.read.text(f"{place}/dates").groupBy(F.col("event_date")).agg(F.count(F.lit(1)).alias("n"))


def clicks_taken_in(spark: SparkSession, d: str, place: str) -> dict[str, int]:
    """Files through the manifest, with a crash after one has been written, then cleaned."""
    source = landed(spark, d, place)
    go = lambda fail: ingest_files(spark, source, f"{place}/bronze", f"{place}/manifest.json", now=lambda: T0, fail=fail)
    try:
        go(crash_once("processed"))
    except Crash:
        pass
    tally = go(lambda step: None)
    P.click_events(spark, f"{place}/bronze", f"{place}/silver", partitions=8)
    P.click_events(spark, f"{place}/bronze", f"{place}/silver", partitions=8)
    return tally


@query("file_manifest", "SELECT unnest(['new', 'retried', 'skipped']) AS outcome, unnest([(SELECT count(DISTINCT CAST(ts AS DATE)) - 2 FROM events), 1, 1]) AS files")
def file_manifest(spark, d):
    """What a run finds after a crash: a file that is pending is taken in again, one that is processed is skipped."""
    place = folder(spark, "manifest")
    tally = clicks_taken_in(spark, d, place)
    return spark.createDataFrame(list(tally.items()), "outcome string, files long").where("outcome in ('new', 'retried', 'skipped')")


@query("serve_clicks", "SELECT user_id AS session_id, ts AS event_timestamp, CAST(ts AS DATE) AS event_date, event_id % 1000 AS item_id, event_type AS category FROM events")
def serve_clicks(spark, d):
    """Events from files to the served table; the second load finds nothing to do."""
    place = folder(spark, "clicks")
    clicks_taken_in(spark, d, place)
    expect([P.serve_clicks(spark, f"{place}/silver", f"{place}/staging") for _ in range(2)], ["LOADED", "NO_OP"])
    served = SnapshotTable(spark, f"{place}/staging").read()
    return served.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))


# weather --------------------------------------------------------------------------------------------------------------

DAYS = 30


def event_days(spark: SparkSession, d: str) -> tuple[date, date]:
    """The first and the last day with events."""
    first, last = V.read(spark, d, "events").agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    return first, last


def server_of(spark: SparkSession, d: str) -> Callable[[dict], tuple[int, dict]]:
    """A server whose weather is what events say: at each place and hour how many there were. It holds a number for each hour with events, as a server does."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    counts = {(r["k"], r["h"]): r["n"] for r in V.read(spark, d, "events").groupBy((F.col("user_id") % len(PLACES)).alias("k"), hour.alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    number = {(p.latitude, p.longitude): k for k, p in enumerate(PLACES)}
    last = event_days(spark, d)[1]

    def server(params: dict) -> tuple[int, dict]:
        first, until = (date.fromisoformat(params[c]) for c in ("start_date", "end_date")) if "start_date" in params else (last, last + timedelta(days=1))
        hours = [datetime(first.year, first.month, first.day) + timedelta(hours=h) for h in range(24 * ((until - first).days + 1))]
        values = [counts.get((number[params["latitude"], params["longitude"]], t), 0) for t in hours]
        hourly = {"time": [t.strftime("%Y-%m-%dT%H:%M") for t in hours], "temperature_2m": [v + 0.5 for v in values], "relative_humidity_2m": [v % 101 for v in values], "precipitation": [v % 3 / 2 for v in values], "wind_speed_10m": [v / 2 for v in values], "weather_code": [v % 4 for v in values]}
        return 200, {"latitude": params["latitude"], "longitude": params["longitude"], "hourly_units": {"time": "iso8601"}, "hourly": hourly}

    return server


PLACES_SQL = "(VALUES " + ", ".join(f"('{p.warehouse_id}', {k})" for k, p in enumerate(PLACES)) + ") p(warehouse_id, k)"
HOURS_SQL = f"SELECT k, date_trunc('hour', ts) AS h, count(*) AS n FROM (SELECT ts, user_id % {len(PLACES)} AS k FROM events) GROUP BY 1, 2"
LAST_DAY, FIRST_DAY = ("(SELECT CAST(CAST(" + f + "(ts) AS DATE) AS TIMESTAMP) FROM events)" for f in ("max", "min"))


def hours_sql(first: str, last: str) -> str:
    """Every hour of every place from the first day to the end of the last, in UTC, with how many events it had."""
    return f"""(SELECT warehouse_id, t - INTERVAL 7 HOUR AS utc, coalesce(n, 0) AS v FROM (SELECT * FROM {PLACES_SQL}, (SELECT unnest(generate_series({first}, {last} + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS t)) g LEFT JOIN ({HOURS_SQL}) c ON c.k = g.k AND c.h = g.t)"""


MEASURES_SQL = "v + CAST(0.5 AS DOUBLE) AS temperature_2m, CAST(v % 101 AS INTEGER) AS relative_humidity_2m, (v % 3) / CAST(2 AS DOUBLE) AS precipitation, v / CAST(2 AS DOUBLE) AS wind_speed_10m, CAST(v % 4 AS INTEGER) AS weather_code"


@query("weather_forecast_served", f"SELECT warehouse_id, utc AS forecast_time, {MEASURES_SQL} FROM {hours_sql(LAST_DAY, f'{LAST_DAY} + INTERVAL 1 DAY')}")
def weather_forecast_served(spark, d):
    """Forecast units for all places, one left without its marker by a crash and fetched again, cleaned and served."""
    place, server = folder(spark, "forecast"), server_of(spark, d)
    try:
        ingest_forecasts(spark, f"{place}/w", T0, "r1", server, now=lambda: T0, fail=crash_once("_SUCCESS"))
    except Crash:
        expect(P.weather_forecast(spark, f"{place}/w", f"{place}/silver"), 1)
    ingest_forecasts(spark, f"{place}/w", T0, "r1", server, now=lambda: T0)
    P.weather_forecast(spark, f"{place}/w", f"{place}/silver")
    expect(P.weather_forecast(spark, f"{place}/w", f"{place}/silver"), 0)
    expect(P.serve_weather(spark, "forecast", f"{place}/silver", f"{place}/staging"), "LOADED")
    return SnapshotTable(spark, f"{place}/staging").read().select("warehouse_id", "forecast_time", *M.MEASURES)


@query("weather_history_served", f"SELECT warehouse_id, utc AS weather_time, {MEASURES_SQL} FROM {hours_sql(FIRST_DAY, LAST_DAY)}")
def weather_history_served(spark, d):
    """Past windows for all places, from the first day with events to the last, taken in, cleaned, merged where they overlap, and served."""
    place, server, (first, last) = folder(spark, "history"), server_of(spark, d), event_days(spark, d)
    n = len(windows(first, last, DAYS)) * len(PLACES)
    expect(ingest_history(spark, f"{place}/w", first, last, "r1", server, days=DAYS, now=lambda: T0), {"committed": n, "skipped": 0})
    expect(ingest_history(spark, f"{place}/w", first, last, "r2", server, days=DAYS, now=lambda: T0), {"committed": 0, "skipped": n})
    expect(P.weather_history(spark, f"{place}/w", f"{place}/silver", f"{place}/control"), n)
    again = min(last, first + timedelta(days=3))
    if again < min(last, first + timedelta(days=DAYS - 1)):  # a window of other ends, over some of the same hours
        ingest_history(spark, f"{place}/w", first, again, "r3", server, PLACES[:2], now=lambda: T0 + timedelta(days=1))
        expect(P.weather_history(spark, f"{place}/w", f"{place}/silver", f"{place}/control"), 2)
    expect(P.serve_weather(spark, "historical", f"{place}/silver", f"{place}/staging"), "LOADED")
    return SnapshotTable(spark, f"{place}/staging").read().select("warehouse_id", "weather_time", *M.MEASURES)


# seed and models ------------------------------------------------------------------------------------------------------


def seed_frames(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The test tables as the nine files would hold them."""
    items = V.stg_order_items(spark, d).withColumn("warehouse_id", F.lit(None).cast("string"))
    lines = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("geolocation_zip_code_prefix"), F.lit(1.5).alias("geolocation_lat"), F.lit(2.5).alias("geolocation_lng"), F.concat(F.col("n_name"), F.lit(', "old"\ntown')).alias("geolocation_city"), F.lit("X").alias("geolocation_state"))
    frames = {
        "geolocation": lines, "product_category_name_translation": V.stg_translation(spark), "customers": V.stg_customers(spark, d), "products": V.stg_products(spark, d), "sellers": V.stg_sellers(spark, d),
        "orders": V.stg_orders(spark, d).drop("source_system"), "order_items": items, "order_payments": V.stg_order_payments(items), "order_reviews": V.stg_order_reviews(spark, d),
    }
    return {n: df.select(*[c for c in df.columns if c in CONTRACTS[n].columns]) for n, df in frames.items()}


SEED_COUNTS = {
    "geolocation": "SELECT count(*) FROM nation", "product_category_name_translation": f"SELECT {len(V.TRANSLATED)}", "customers": "SELECT count(*) FROM customer", "products": "SELECT count(*) FROM part", "sellers": "SELECT count(*) FROM supplier",
    "orders": "SELECT count(*) FROM orders", "order_items": "SELECT count(*) FROM stg_order_items", "order_payments": "SELECT count(*) FROM stg_order_items", "order_reviews": "SELECT count(*) FROM lineitem WHERE l_linenumber = 1",
}


#: Records of one CSV file.
SEED_ROWS = 500_000


def seeded(spark: SparkSession, d: str, place: str) -> dict[str, int]:
    names = {t: f for f, t in SEED_FILES.items()}
    for n, df in seed_frames(spark, d).items():  # each a folder of files, which are what tasks read whole: records may hold line breaks
        df.write.options(header=True, escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss", maxRecordsPerFile=SEED_ROWS).csv(f"{place}/raw/{names[n]}")
    return load_seed(spark, f"{place}/raw", f"{place}/seed")


@query("seed_load", " UNION ALL ".join(f"SELECT '{n}' AS table_name, ({q}) AS rows" for n, q in SEED_COUNTS.items()))
def seed_load(spark, d):
    """Nine files into tables, all or none."""
    loaded = seeded(spark, d, folder(spark, "seed"))
    return spark.createDataFrame(list(loaded.items()), "table_name string, rows long")


@query("dq_seed_load", " UNION ALL ".join([f"SELECT 'row_count_{n}' AS check_name, CAST(0 AS BIGINT) AS failures" for n in SEED_FILES.values()] + [
    f"SELECT 'null_{t}_{c}', {f'(SELECT count(*) FROM {q})' if q else 'CAST(0 AS BIGINT)'}" for t, c, q in (
        ("customers", "customer_unique_id", ""), *(("orders", c, "") for c in ("customer_id", "order_status", "order_purchase_timestamp")), *(("order_items", c, "") for c in ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")),
        *(("order_payments", c, "") for c in ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value")), *(("order_reviews", c, "") for c in ("review_id", "order_id")))]))
def dq_seed_load(spark, d):
    """Files against tables, and columns that must not be null."""
    place = folder(spark, "seed-checks")
    seeded(spark, d, place)
    tables = {n: SnapshotTable(spark, f"{place}/seed/{n}").read() for n in SEED_FILES.values()}
    return row_count_checks(spark, f"{place}/raw", tables).unionByName(null_checks(tables))


@query("materialised_models", f"SELECT order_status, count(*) AS orders, CAST(sum(CAST(total_payment_value AS DECIMAL(20,2))) AS DOUBLE) AS revenue FROM ({FACT_ORDERS}) GROUP BY 1")
def materialised_models(spark, d):
    """Models by name, some as views, the fact as a table, a measure over it in SQL."""
    r = Registry(spark, lambda name: V.source(name)(spark, d), folder(spark, "models"))
    r.add(Model("m_measure", lambda ref: ref("m_fact_orders").sparkSession.sql("SELECT order_status, count(*) AS orders, sum(total_payment_value) AS revenue FROM m_fact_orders GROUP BY order_status"), ("m_fact_orders",)))
    r.add(Model("m_fact_orders", lambda ref: M.with_order_keys(ref("m_enriched")), ("m_enriched",), TABLE))
    r.add(Model("m_enriched", lambda ref: M.int_orders_enriched(ref("orders"), ref("m_items"), ref("m_payments")), ("m_items", "m_payments"), schema="intermediate"))
    r.add(Model("m_payments", lambda ref: V.stg_order_payments(ref("m_items")), ("m_items",)))
    r.add(Model("m_items", lambda ref: ref("order_items")))
    return r.build()["m_measure"]


# aggregates that add up -------------------------------------------------------------------------------------------------


@query("agg_daily_increments", AGG_DAILY)
def agg_daily_increments(spark, d):
    """The daily aggregate from two increments that share days and sessions, the second one added twice as after a crash."""
    states, events = DailyStates(spark, folder(spark, "daily")), V.clicks(spark, d)
    second = F.pmod(F.xxhash64("session_id", "event_timestamp"), F.lit(2)) == 1
    states.add(events.where(~second), "first")
    for _ in range(2):
        states.add(events.where(second), "second")
    return states.daily()
