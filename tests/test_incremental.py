import time
from datetime import datetime, timedelta

import pytest

from quern.storage import Files
from quern.contracts import CONTRACTS, TableContract, contract_of
from quern.operators.versions import latest_state
from quern.sources.incremental import Ingestion, Pending, State, StateError
from quern.sources.readers import read_bronze

C = TableContract("things", ("a", "b"), {"a": "string", "b": "int32", "v": "decimal_10_2", "note": "string", "created_at": "timestamp_us", "updated_at": "timestamp_us"})
T0 = datetime(2026, 1, 1, 0, 0, 0, 123456)


def rows(spark, n=25, start=0):
    data = [(f"k{i % 7}", i, None, None, T0, None if i == 3 and start == 0 else T0 + timedelta(minutes=(i + start) // 3)) for i in range(n)]
    return spark.createDataFrame(data, C.schema())


class Crash(Exception):
    pass


def crash_at(step):
    def fail(s):
        if s == step:
            raise Crash(s)

    return fail


def ingestion(spark, tmp_path, df, **options):
    return Ingestion(spark, C, lambda: df, f"{tmp_path}/bronze", f"{tmp_path}/state", 10, now=lambda: T0, **options)


def ids(spark, tmp_path):
    return sorted(r["b"] for r in read_bronze(spark, C, f"{tmp_path}/bronze").collect())


def test_batches_then_nothing_new(spark, tmp_path):
    df = rows(spark)
    i = ingestion(spark, tmp_path, df)
    assert i.run("run:1+x") == {"status": "run_completed", "batches": 3, "replayed": 0}
    assert i.run("run2")["status"] == "no_new_data"
    assert ids(spark, tmp_path) == [x for x in range(25) if x != 3]  # a row without a watermark waits for one
    b = read_bronze(spark, C, f"{tmp_path}/bronze")
    assert b.where("_source_updated_at <> updated_at or _source_table <> 'things' or _ingestion_method <> 'timestamp_incremental'").count() == 0
    assert b.schema["note"].dataType.simpleString() == "string" and b.schema["updated_at"].dataType.simpleString() == "timestamp_ntz"
    assert sorted({r[0] for r in b.select("_ingestion_id").collect()}) == [f"run-1_x_batch_{n:06d}" for n in (1, 2, 3)]
    more = df.unionByName(rows(spark, 5, 100).selectExpr("a", "b + 100 as b", "v", "note", "created_at", "updated_at").withColumn("b", __import__("pyspark").sql.functions.col("b").cast("int")))
    assert ingestion(spark, tmp_path, more).run("run3")["batches"] == 1
    assert len(ids(spark, tmp_path)) == 29


@pytest.mark.parametrize("step,replayed", [("read", 0), ("pending", 0), ("write", 1), ("checkpoint", 1), ("drop", 0)])
def test_crash_at_each_step(spark, tmp_path, step, replayed):
    df = rows(spark, 15)
    with pytest.raises(Crash):
        ingestion(spark, tmp_path, df, fail=crash_at(step)).run("r")
    got = ingestion(spark, tmp_path, df).run("r")
    assert got["replayed"] == replayed and got["status"] == "run_completed"
    assert ids(spark, tmp_path) == [x for x in range(15) if x != 3]
    assert ingestion(spark, tmp_path, df).state.pending() is None


def test_empty_source(spark, tmp_path):
    assert ingestion(spark, tmp_path, rows(spark).limit(0)).run("r")["status"] == "source_empty"


def test_state_is_checked(spark, tmp_path):
    s = State(spark, C, str(tmp_path))
    low, mid, top = ({"updated_at": T0 + timedelta(days=d), "a": "x", "b": d} for d in (1, 2, 3))
    good = Pending("r", top, low, mid, "e", "2026-01-01T00:00:00.000000", 10)
    s.save_pending(good)
    assert s.pending() == good
    for bad in ({"batch_size": 0}, {"batch_size": True}, {"batch_size": "10"}, {"batch_upper": low}, {"lower": top}, {"run_upper": low}, {"extraction_id": ""}):
        with pytest.raises(StateError):
            s.save_pending(Pending(**(good.__dict__ | bad)))
    s.files.write(s.pending_path, "{")
    with pytest.raises(StateError):
        s.pending()
    s.files.write(s.checkpoint_path, '{"version": 1, "table_name": "other", "watermark": {}}')
    with pytest.raises(StateError):
        s.checkpoint()
    s.drop_pending()
    s.drop_pending()
    assert s.pending() is None


def test_pending_that_fits_nothing(spark, tmp_path):
    i = ingestion(spark, tmp_path, rows(spark))
    mark = lambda d: {"updated_at": T0 + timedelta(minutes=d), "a": "k", "b": 1}
    i.state.save_pending(Pending("r", mark(3), mark(1), mark(2), "e", "2026-01-01T00:00:00.000000", 10))
    with pytest.raises(StateError):
        i.run("r")


def test_contracts():
    assert len(CONTRACTS) == 11 and contract_of("inventory").cursor == ("updated_at", "warehouse_id", "product_id")
    assert contract_of("order_items").initial_watermark() == {"updated_at": datetime(1970, 1, 1), "order_id": "", "order_item_id": 0}
    good = dict(name="t", key=("a",), columns={"a": "string", "updated_at": "timestamp_us"})
    for bad in ({"name": "1x"}, {"key": ()}, {"key": ("a", "a")}, {"key": ("z",)}, {"key": ("updated_at",)}, {"columns": {"a": "text", "updated_at": "timestamp_us"}}, {"columns": {"a": "string"}}, {"columns": {"a": "string", "updated_at": "string"}}, {"columns": {"a": "decimal_10_2", "updated_at": "timestamp_us"}}, {"columns": {"a;": "string", "a": "string", "updated_at": "timestamp_us"}}):
        with pytest.raises(ValueError):
            TableContract(**(good | bad))
    with pytest.raises(KeyError):
        contract_of("nothing")


def test_latest_state(spark):
    t = lambda d: T0 + timedelta(days=d)
    data = [("a", t(1), t(1), 1), ("a", t(2), t(1), 2), ("b", t(1), t(1), 1), ("b", t(1), t(2), 2), ("c", None, t(9), 1), ("c", t(0), None, 2), ("d", t(1), t(1), 1), ("d", t(1), t(1), 1)]
    df = spark.createDataFrame(data, "k string, updated_at timestamp_ntz, _ingested_at timestamp_ntz, v int")
    assert {r["k"]: r["v"] for r in latest_state(df, ["k"]).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1}
    with pytest.raises(Exception, match="null in key"):
        latest_state(df.unionByName(spark.createDataFrame([(None, t(1), t(1), 1)], df.schema)), ["k"]).collect()


def test_later_batches_are_written_while_one_is_ended(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i, None, None, T0, T0 + timedelta(minutes=i)) for i in range(25)], C.schema())
    seen = []

    def fail(step):
        if step == "pending":
            seen.append(sorted(n for n in Files(spark).names(f"{tmp_path}/state/staged") if "_batch_" in n) if not seen else [])
            if len(seen) == 2:
                raise RuntimeError("crash")

    with pytest.raises(RuntimeError, match="crash"):
        ingestion(spark, tmp_path, df, fail=lambda s: (time.sleep(5), fail(s)) if s == "pending" and not seen else fail(s)).run("r")
    assert len(seen[0]) == 3  # all three batches lie beside before the first is ended
    assert read_bronze(spark, C, f"{tmp_path}/bronze").count() == 10
    assert ingestion(spark, tmp_path, df).run("r")["batches"] == 2
    assert read_bronze(spark, C, f"{tmp_path}/bronze").select("b").distinct().count() == 25 == read_bronze(spark, C, f"{tmp_path}/bronze").count()
    assert not [n for n in Files(spark).names(f"{tmp_path}/state/staged") if "_batch_" in n]
