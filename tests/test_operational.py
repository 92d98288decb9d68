from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.contracts import contract_of
from quern.plans import pipelines as P
from quern.sources.incremental import Ingestion
from quern.sources.readers import read_seed
from quern.storage import SnapshotTable

T0 = datetime(2026, 1, 1)


def sources(spark, later=()):
    orders = [(f"o{i}", f"c{i % 3}", None if i % 4 == 0 else "WH_HN", "created", T0, None, None, None, None, "simulator", T0, T0 + timedelta(hours=i)) for i in range(8)]
    orders += [(k, "c1", "WH_HN", "approved", T0, T0, None, None, None, "simulator", T0, T0 + timedelta(days=n)) for k, n in later]
    items = [(f"o{i}", n, "p", "s", None, None, None, "WH_HN", 1, T0, T0 + timedelta(hours=i)) for i in range(8) for n in (1, 2)]
    return {"orders": spark.createDataFrame(orders, contract_of("orders").schema()), "order_items": spark.createDataFrame(items, contract_of("order_items").schema())}


def ingest(spark, tmp_path, frames, run):
    for name, df in frames.items():
        Ingestion(spark, contract_of(name), lambda df=df: df, f"{tmp_path}/bronze", f"{tmp_path}/state", 3, now=lambda: T0 + timedelta(days=run)).run(f"run{run}")


def test_end_to_end(spark, tmp_path):
    names, places = ("orders", "order_items"), [f"{tmp_path}/{x}" for x in ("bronze", "silver", "staging")]
    ingest(spark, tmp_path, sources(spark), 1)
    assert P.operational(spark, names, *places) == {"orders": 8, "order_items": 16}
    assert P.operational(spark, names, *places) == {"orders": 0, "order_items": 0}
    ingest(spark, tmp_path, sources(spark, [("o1", 40), ("o9", 41)]), 2)
    assert P.operational(spark, names, *places) == {"orders": 2, "order_items": 0}
    got = SnapshotTable(spark, f"{tmp_path}/staging/orders").read()
    assert got.count() == 9 and got.where("order_id = 'o1'").first()["order_status"] == "approved" and str(got.where("order_id = 'o9'").first()["order_purchase_date"]) == "2026-01-01"
    assert not {"ingestion_date", "extraction_id"} & set(got.columns)
    marts = got.join(SnapshotTable(spark, f"{tmp_path}/staging/order_items").read().groupBy("order_id").agg(F.count("*").alias("n")), "order_id", "left")
    assert {r["n"] for r in marts.collect()} == {2, None}


def test_null_key_is_refused(spark, tmp_path):
    bad = sources(spark)["orders"].withColumn("order_id", F.when(F.col("order_id") != "o3", F.col("order_id")))
    i = Ingestion(spark, contract_of("orders"), lambda: bad, f"{tmp_path}/bronze", f"{tmp_path}/state", 100, now=lambda: T0)
    i.write(contract_of("orders").select(bad), __import__("quern.sources.incremental", fromlist=["Pending"]).Pending("r", {}, {}, {}, "e1", "2026-01-01T00:00:00.000000", 1))
    with pytest.raises(Exception, match="null in key"):
        P.silver_table(spark, "orders", f"{tmp_path}/bronze", f"{tmp_path}/silver")
    assert not SnapshotTable(spark, f"{tmp_path}/silver/orders").exists()


def test_seed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("warehouse_id,warehouse_city\nWH_HN,Ha Noi\nWH_X,\n")
    rows = read_seed(spark, contract_of("warehouses"), f"{tmp_path}/s.csv", warehouse_region="NORTH").collect()
    assert [tuple(r)[:3] for r in rows] == [("WH_HN", "Ha Noi", "NORTH"), ("WH_X", None, "NORTH")] and rows[0]["updated_at"] is None
