from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.contracts import contract_of
from quern.functions.scalar import quoted
from quern.operators import quality as Q
from quern.plans import pipelines as P
from quern.plans.kpis import require_one_fact
from quern.plans.registry import TABLE, Model, Registry
from quern.protocols import seeded
from quern.simulator import decremented, generate_orders, latest_prices, oldest_due
from quern.sources.files import split_by_date, upload_landing
from quern.sources.incremental import Ingestion, type_checks
from quern.sources.readers import discover, read_clicks
from quern.sources.seed import SEED_FILES, load_seed
from quern.storage import Files, SnapshotTable

T0 = datetime(2026, 1, 1)


def orders(spark, n):
    return spark.range(n).select(*[(F.format_string("o%06d", "id") if c == "order_id" else F.lit("x") if t == "string" else F.timestamp_seconds(1_700_000_000 + F.col("id") % 7).cast("timestamp_ntz")).alias(c) for c, t in contract_of("orders").columns.items()])


def test_source_is_read_as_often_for_many_batches_as_for_one(spark, tmp_path):
    reads = {}
    for size in (1000, 50):
        calls = []
        i = Ingestion(spark, contract_of("orders"), lambda: calls.append(1) or orders(spark, 1000), f"{tmp_path}/b{size}", f"{tmp_path}/s{size}", size, now=lambda: T0)
        assert i.run("r")["batches"] == 1000 // size
        reads[size] = len(calls)
        raw = spark.read.parquet(f"{tmp_path}/b{size}/orders")
        assert raw.count() == raw.select("order_id").distinct().count() == 1000
        counts = [r["count"] for r in raw.groupBy("_ingestion_id").count().collect()]
        assert set(counts) == {size}
        assert not Files(spark).exists(f"{tmp_path}/s{size}/staged/orders")
    assert reads[1000] == reads[50] == 2


def test_wrong_types_are_found(spark, tmp_path):
    c = contract_of("orders")
    Ingestion(spark, c, lambda: orders(spark, 10), f"{tmp_path}/b", f"{tmp_path}/s", now=lambda: T0).run("r")
    assert type_checks(spark, c, f"{tmp_path}/b").where("failures > 0").count() == 0
    spark.read.parquet(f"{tmp_path}/b/orders").drop("ingestion_date", "extraction_id").withColumn("customer_id", F.lit(1)).write.parquet(f"{tmp_path}/b/orders/ingestion_date=2026-01-02/extraction_id=x")
    assert [r["check_name"] for r in type_checks(spark, c, f"{tmp_path}/b").where("failures > 0").collect()] == ["type_customer_id"]


def test_quoted_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,2024-01-01T00:00:00Z,5,"a, ""b"""\n2,,,\n')
    assert [tuple(r) for r in read_clicks(spark, f"{tmp_path}/a.csv").collect()] == [("1", "2024-01-01T00:00:00Z", "5", 'a, "b"'), ("2", "", "", "")]
    for bad in ("1,2,3", "1,2,3,4,5"):
        (tmp_path / "bad.csv").write_text(bad + "\n")
        with pytest.raises(Exception, match="not four fields"):
            read_clicks(spark, f"{tmp_path}/bad.csv").collect()


def test_known_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1\n")
    (tmp_path / "b.csv").write_text("2\n")
    first = discover(spark, str(tmp_path))
    known = first.withColumn("etag", F.lit("kept")).where("relative_path = 'a.csv'")
    assert {r["relative_path"]: r["etag"] for r in discover(spark, str(tmp_path), known=known).collect()} == {"a.csv": "kept", "b.csv": first.where("relative_path = 'b.csv'").first()["etag"]}


def test_upload_refuses_another_size(spark, tmp_path):
    (tmp_path / "from" / "d").mkdir(parents=True)
    (tmp_path / "from" / "d" / "a.csv").write_text("one\n")
    assert upload_landing(spark, f"{tmp_path}/from", f"{tmp_path}/to") == {"uploaded": 1, "skipped": 0}
    assert upload_landing(spark, f"{tmp_path}/from", f"{tmp_path}/to") == {"uploaded": 0, "skipped": 1}
    (tmp_path / "from" / "d" / "a.csv").write_text("other\n")
    with pytest.raises(ValueError, match="bytes"):
        upload_landing(spark, f"{tmp_path}/from", f"{tmp_path}/to")


def test_chunks_of_lines(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("".join(f"1,2024-01-0{1 + i % 2}T00:00:00Z,1,1\n" for i in range(20)))
    split_by_date(spark, f"{tmp_path}/raw.txt", f"{tmp_path}/out", chunk_lines=4, max_chunks=3)
    assert spark.read.text(f"{tmp_path}/out").count() == 12
    assert len(list((tmp_path / "out" / "event_date=2024-01-01").glob("part-*"))) >= 2


def test_merge_writes_only_buckets_that_change(spark, tmp_path):
    t = SnapshotTable(spark, f"{tmp_path}/t")
    rows = lambda ids, v: spark.createDataFrame([(i, v, datetime(2026, 1, v), T0) for i in ids], "k long, v int, updated_at timestamp_ntz, _ingested_at timestamp_ntz")
    assert t.merge(rows(range(100), 1), ["k"], buckets=8) == 100
    before = set(t.state()["parts"])
    assert t.merge(rows([3], 2), ["k"]) == 1 and len(before & set(t.state()["parts"])) == 7
    assert {r["k"]: r["v"] for r in t.read().collect()} == {i: 2 if i == 3 else 1 for i in range(100)} and t.read().columns == ["k", "v", "updated_at", "_ingested_at"]
    assert t.merge(rows([3], 2), ["k"]) == 0 and t.vacuum() == 0


def clicks(spark, tmp_path, category="a", name="2024-01-01"):
    path = f"{tmp_path}/bronze/ingestion_date=2026-01-01/ingestion_id=i{name}"
    spark.createDataFrame([("1", f"{name}T01:00:00Z", "5", category, "s", f"x/event_date={name}/a.csv", "e", f"i{name}")], "session_id string, event_timestamp string, item_id string, category string, _source_name string, _source_file_path string, _source_file_etag string, _ingestion_id string").write.mode("overwrite").parquet(path)


def test_click_log_and_crash_before_it(spark, tmp_path):
    go = lambda: P.click_events(spark, f"{tmp_path}/bronze", f"{tmp_path}/silver", partitions=2)
    clicks(spark, tmp_path)
    assert go() == 1 and go() == 0
    clicks(spark, tmp_path, name="2024-01-02")
    log = f"{tmp_path}/silver_files/_current.json"
    old = Files(spark).read(log)
    assert go() == 1
    Files(spark).write(log, old)  # as if the log had not been reached
    assert go() == 1 and SnapshotTable(spark, f"{tmp_path}/silver").read().count() == 2 and go() == 0
    clicks(spark, tmp_path, " ", "2024-01-03")
    with pytest.raises(Q.QualityError, match="blank_category"):
        go()
    assert SnapshotTable(spark, f"{tmp_path}/silver").read().count() == 2


def test_no_op_still_checks_what_is_served(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0, T0.date(), 5, "a")], "session_id long, event_timestamp timestamp_ntz, event_date date, item_id long, category string")
    for place in ("silver", "staging"):  # the same rows in both, so that nothing is loaded
        SnapshotTable(spark, f"{tmp_path}/{place}").overwrite(rows.withColumn("category", F.lit(" ")))
    with pytest.raises(Q.QualityError, match="blank_category"):
        P.serve_clicks(spark, f"{tmp_path}/silver", f"{tmp_path}/staging")


def test_null_weather_values_are_counted(spark):
    cols = {"warehouse_id": "string", "ingestion_id": "string", "weather_time": "timestamp", "retrieved_at": "timestamp", "window_start": "date", "window_end": "date", "temperature_2m": "double", "relative_humidity_2m": "int", "precipitation": "double", "wind_speed_10m": "double", "weather_code": "int"}
    df = spark.createDataFrame([(None,) * len(cols)], ", ".join(f"{c} {t}" for c, t in cols.items()))
    got = {r["check_name"]: r["failures"] for r in Q.history_checks(df).collect()}
    assert len(got) == 16 and sum(got.values()) == 11


def test_seed_is_loaded_whole_or_not(spark, sf_dir, tmp_path):
    seeded(spark, sf_dir, str(tmp_path / "one"))
    raw = tmp_path / "one" / "raw"
    with pytest.raises(ValueError, match="loaded before"):
        load_seed(spark, str(raw), str(tmp_path / "one" / "seed"))
    gone = raw / next(iter(SEED_FILES))
    gone.rename(tmp_path / "kept.csv")
    with pytest.raises(FileNotFoundError):
        load_seed(spark, str(raw), str(tmp_path / "two"))
    (tmp_path / "kept.csv").rename(gone)
    plan, real = [], SnapshotTable.point

    def crash(self, *a, **k):
        plan.append(self.path)
        if len(plan) == 4:
            raise RuntimeError("crash")
        return real(self, *a, **k)

    SnapshotTable.point = crash
    try:
        with pytest.raises(RuntimeError):
            load_seed(spark, str(raw), str(tmp_path / "three"))
    finally:
        SnapshotTable.point = real
    assert set(load_seed(spark, str(raw), str(tmp_path / "three"))) == set(SEED_FILES.values())  # the plan is ended


def test_registry(spark, tmp_path):
    r = Registry(spark, lambda n: spark.range(int(n)), str(tmp_path))
    r.add(Model("t_b", lambda ref: ref("t_a").where("id > 1"), ("t_a",), TABLE)).add(Model("t_a", lambda ref: ref("5")))
    assert r.build()["t_b"].count() == 3 == spark.table("t_b").count() == SnapshotTable(spark, f"{tmp_path}/marts/t_b").read().count()
    with pytest.raises(ValueError, match="two models"):
        r.add(Model("t_a", lambda ref: ref("5")))
    with pytest.raises(ValueError, match="there aren't"):
        Registry(spark, None, "x").add(Model("t_c", lambda ref: ref("no"), ("no",))).build()
    with pytest.raises(ValueError, match="before it is built"):
        Registry(spark, None, "x").add(Model("t_c", lambda ref: ref("t_d"))).add(Model("t_d", lambda ref: ref("t_c"), ("t_c",))).build()


def test_simulated_orders_take_from_stock(spark):
    at = "2026-01-01 00:00:00"
    lines = spark.createDataFrame([(f"p{i}", d, f"o{d}", f"2026-01-0{d}") for i in range(9) for d in (1, 2)], "product_id string, price int, order_id string, updated_at string")
    prices = latest_prices(lines)
    assert {r["price"] for r in prices.collect()} == {2} and prices.count() == 9
    products = prices.select("product_id", F.col("price").cast("decimal(10,2)").alias("price"))
    stock = spark.createDataFrame([(w, f"p{i}", 4) for w in ("A", "B") for i in range(9)], "warehouse_id string, product_id string, quantity_available int")
    o, items, payments = generate_orders(spark, 60, products, 10, at, stock=stock)
    left = decremented(stock, items)
    assert left.where("quantity_available < 0").count() == 0 and 0 < left.agg(F.sum("quantity_available")).first()[0] < 72
    assert left.agg(F.sum("quantity_available")).first()[0] + items.agg(F.sum("quantity")).first()[0] == 72
    assert o.count() == payments.count() == items.select("order_id").distinct().count()
    assert items.join(o.select("order_id", F.col("warehouse_id").alias("w")), "order_id").where("w <> warehouse_id").count() == 0
    due = oldest_due(o.withColumn("updated_at", F.lit(at).cast("timestamp_ntz")), "2026-01-02 00:00:00", 7).collect()
    assert len(due) == 7 and [r["order_id"] for r in due] == sorted(r["order_id"] for r in due)


def test_steps_of_an_order(spark):
    from quern import simulator as S

    cols = "order_id string, order_status string, updated_at timestamp_ntz, order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, source_system string"
    at = lambda *a: datetime(2026, 1, *a)
    orders = spark.createDataFrame([("o", "created", at(1), None, None, None, "simulator")], cols)
    seen = []
    for now in ("2026-01-01 00:01:59", "2026-01-01 00:02:00", "2026-01-01 00:16:59", "2026-01-01 00:17:00", "2026-01-01 02:17:00", "2026-01-02 02:16:00", "2026-01-02 02:17:00", "2027-01-01 00:00:00"):
        moved = S.cycle(orders, now, 10, draw=F.lit(5))
        orders = spark.createDataFrame(S.applied(orders, moved).collect(), cols)
        seen.append(orders.first()["order_status"])
    assert seen == ["created", "approved", "approved", "processing", "shipped", "shipped", "delivered", "delivered"]
    r = orders.first()
    assert (r["order_approved_at"], r["order_delivered_carrier_date"], r["order_delivered_customer_date"]) == (at(1, 0, 2), at(1, 2, 17), at(2, 2, 17))
    moved = S.cycle(spark.createDataFrame([("o", "created", at(1), None, None, None, "simulator")], cols), "2026-01-02 00:00:00", 1, draw=F.lit(95))
    assert moved.first()["order_status"] == "canceled" and [tuple(x) for x in S.transitions(moved).collect()] == [("created", "canceled", 1)]
    with pytest.raises(Exception, match="another cycle"):
        S.applied(orders, moved).collect()
    stock = spark.createDataFrame([("A", "p", 1)], "warehouse_id string, product_id string, quantity_available int")
    items = spark.createDataFrame([("o", "A", "p", 3)], "order_id string, warehouse_id string, product_id string, quantity int")
    assert S.returned_stock(stock, moved, items).first()["quantity_available"] == 4
    with pytest.raises(Exception, match="no stock row"):
        S.returned_stock(stock.where("false"), moved, items).collect()


def test_small_guards():
    assert quoted("a`b.c") == "`a``b.c`" and quoted('x"', '"') == '"x"""'


def test_measures_of_two_facts_do_not_mix(spark):
    a, b = spark.range(1).withColumn("order_count", F.lit(1)), spark.range(1).withColumn("session_count", F.lit(1))
    require_one_fact(a, a)
    with pytest.raises(ValueError, match="different facts"):
        require_one_fact(a, b)


def test_wrong_types_are_written_without_a_sort(spark, sf_dir, monkeypatch):
    from quern.protocols import dq_bronze_types

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.partitionBy", lambda *a: pytest.fail("a write by folders sorts all rows of its task"))
    assert sorted({r["failures"] for r in dq_bronze_types(spark, sf_dir).collect()}) == [0, 3]


def test_seed_files_are_bounded(spark, sf_dir, tmp_path, monkeypatch):
    from quern import protocols

    monkeypatch.setattr(protocols, "SEED_ROWS", 400)
    loaded = seeded(spark, sf_dir, str(tmp_path))
    parts = spark.read.options(header=True, multiLine=True, escape='"').csv(f"{tmp_path}/raw/olist_order_items_dataset.csv").groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in parts) <= 400 and sum(r["count"] for r in parts) == loaded["order_items"] > 2000
    towns = SnapshotTable(spark, f"{tmp_path}/seed/geolocation").read()
    assert loaded["geolocation"] == 25 == towns.where(F.col("geolocation_city").contains('"old"\ntown')).count()
