from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern import simulator as S
from quern.operators import quality as Q
from quern.operators.clickstream import unseen_events, write_events
from quern.operators.versions import keyset_predicate
from quern.operators.weather import exploded
from quern.plans import marts as M


def test_enriched_without_items_or_payments(spark):
    orders = spark.createDataFrame([("o1", "c", "w", "delivered", datetime(2026, 1, 1, 23), None, None, datetime(2026, 1, 3, 1), None, "s", None, None), ("o2", "c", None, "created", datetime(2026, 1, 1), None, None, None, None, "s", None, None)], "order_id string, customer_id string, warehouse_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz, source_system string, created_at timestamp_ntz, updated_at timestamp_ntz")
    items = spark.createDataFrame([("o1", 1, "p", "s", None, 2, 10.0, 1.0), ("o1", 2, "p", "t", "w", 1, 5.5, 0.5)], "order_id string, order_item_id int, product_id string, seller_id string, warehouse_id string, quantity int, price double, freight_value double").withColumn("price", F.col("price").cast("decimal(10,2)")).withColumn("freight_value", F.col("freight_value").cast("decimal(10,2)"))
    payments = spark.createDataFrame([("o1", "card", 3, 1)], "order_id string, payment_type string, payment_installments int, payment_value int").withColumn("payment_value", F.col("payment_value").cast("decimal(10,2)"))
    r = {x["order_id"]: x for x in M.fact_orders(orders, items, payments).collect()}
    assert (r["o1"]["item_line_count"], r["o1"]["total_quantity"], r["o1"]["distinct_seller_count"], r["o1"]["distinct_warehouse_count"], float(r["o1"]["merchandise_value"])) == (2, 3, 2, 1, 25.5)
    assert r["o1"]["delivery_days"] == 2 and r["o1"]["purchase_date_key"] == 20260101 and r["o1"]["approved_date_key"] is None
    assert r["o2"]["item_line_count"] is None and r["o2"]["total_payment_value"] is None and not r["o2"]["has_items"] and not r["o2"]["has_order_warehouse"] and r["o2"]["delivery_days"] is None


def test_day_without_session_start(spark):
    t = lambda d, h, s=0: datetime(2026, 1, d, h, 0, s, 600_000 if s else 0)
    e = spark.createDataFrame([(1, t(1, 23), 5, "a"), (1, t(2, 1), 6, None), (2, t(1, 1), 5, "a"), (2, t(1, 1, 1), 5, "b")], "session_id long, event_timestamp timestamp_ntz, item_id long, category string").withColumn("event_date", F.to_date("event_timestamp"))
    s = M.int_clickstream_sessions(e)
    assert {r["session_id"]: r["session_duration_seconds"] for r in s.collect()} == {1: 7200, 2: 2}
    assert {r["session_id"]: r["is_cross_date_session"] for r in M.fact_clickstream_sessions(s).collect()} == {1: True, 2: False}
    assert {str(r["event_date"]): (r["sessions_started"], r["active_session_count"]) for r in M.agg_clickstream_daily(e, s).collect()} == {"2026-01-01": (2, 2), "2026-01-02": (None, 1)}


def test_unequal_arrays(spark):
    rows = spark.range(1).selectExpr("'i' ingestion_id", "named_struct('time', array('2026-01-01T00:00'), 'temperature_2m', array(1D, 2D), 'relative_humidity_2m', array(1), 'precipitation', array(1D), 'wind_speed_10m', array(1D), 'weather_code', array(1)) hourly")
    with pytest.raises(Exception, match="unequal length"):
        exploded(rows).collect()


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "b")], "k int, v string")
    assert {r[0]: r[1] for r in Q.not_null(df, ["k", "v"]).collect()} == {"not_null_k": 1, "not_null_v": 1}
    assert Q.unique(df, ["k"], "k").first()["failures"] == 1 and Q.null_keys(df, ["k", "v"]).count() == 2
    assert Q.relationship(df, "k", spark.createDataFrame([(2,)], "p int"), "p", "x").first()["failures"] == 2
    assert Q.conflicts(spark.createDataFrame([(1, None, 2), (1, 1, 2), (2, 1, 1), (2, 1, 1)], "k int, a int, b int"), ["k"], ["a", "b"]).collect()[0][:] == (1, 2)
    assert Q.counters(df.limit(0), {"x": F.col("k") > 0}).first()["failures"] == 0
    with pytest.raises(Q.QualityError, match="not_null_k=1"):
        Q.require_clean(Q.not_null(df, ["k"]))
    with pytest.raises(Q.QualityError):
        Q.require_same_count(df, df.limit(1), "x")


def test_changed_source(spark):
    raw = spark.createDataFrame([("1", "2026-01-01T00:00:00Z", "2", "c", "event_date=2026-01-01/a", "e1")], "session_id string, event_timestamp string, item_id string, category string, _source_file_path string, _source_file_etag string")
    seen = spark.createDataFrame([("event_date=2026-01-01/a", "e0")], "_source_file_path string, _source_file_etag string")
    assert unseen_events(raw, seen.limit(0)).count() == 1 and unseen_events(raw, raw).count() == 0
    with pytest.raises(ValueError, match="changed"):
        unseen_events(raw, seen)


def test_partitioned_events(spark, tmp_path):
    e = spark.range(50).selectExpr("id session_id", "date_add(date'2026-01-01', int(id % 3)) event_date")
    write_events(e, f"{tmp_path}/e", 4)
    write_events(e, f"{tmp_path}/e", 4)
    assert spark.read.parquet(f"{tmp_path}/e").where("event_date = date'2026-01-02'").count() == 34


def test_keyset_predicate_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").where(keyset_predicate(("o_orderdate", "o_orderkey"), (datetime(1997, 1, 1), 5), ">"))
    assert "GreaterThanOrEqual(o_orderdate" in df._jdf.queryExecution().executedPlan().toString()


def test_simulator(spark):
    products = spark.range(20).selectExpr("concat('p', id) product_id", "cast(id + 1 as decimal(10,2)) price")
    orders, items, payments = S.generate_orders(spark, 400, products, 50, "2026-01-01 00:00:00")
    again = S.generate_orders(spark, 400, products, 50, "2026-01-01 00:00:00")
    assert sorted(items.collect()) == sorted(again[1].collect())
    n = {r["order_id"]: r["count"] for r in items.groupBy("order_id").count().collect()}
    assert len(n) == 400 and set(n.values()) == {1, 2, 3, 4} and payments.count() == 400
    assert Q.reconciled(payments.select("order_id", "payment_value"), items.selectExpr("order_id", "price * quantity + freight_value v"), "order_id", "payment_value", "v").count() == 0
    day = S.advance(orders, "2026-01-01 00:05:00")
    states = {r["order_status"]: r["count"] for r in day.groupBy("order_status").count().collect()}
    assert set(states) == {"approved", "canceled", "unavailable"} and states["approved"] > 320
    assert S.advance(orders, "2026-01-01 00:01:00").where("order_status <> 'created'").count() == 0
    assert S.oldest_due(day, "2026-01-01 01:00:00", 10).count() == 10 and S.oldest_due(day.where("order_status = 'canceled'"), "2026-02-01 00:00:00", 10).count() == 0
