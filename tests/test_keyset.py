import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.contracts import TableContract
from quern.sources.incremental import METHOD
from quern.sources.readers import read_bronze
from quern.streaming.keyset import KeysetReader, as_value, ingest_keyset, keyset_stream

C = TableContract("things", ("a", "b"), {"a": "string", "b": "int32", "v": "decimal_10_2", "note": "string", "created_at": "timestamp_us", "updated_at": "timestamp_us"})
T0 = datetime(2026, 1, 1, 0, 0, 0, 123456)


def rows(spark, first, n):
    """Three rows a minute, keys that don't follow time; the first row has no time."""
    data = [(f"k{i * 7 % 11}", i, None, "é" if i % 2 else None, T0, None if i == 0 else T0 + timedelta(minutes=i // 3)) for i in range(first, first + n)]
    return spark.createDataFrame(data, C.schema())


def run(spark, place, run_id="r", **more):
    meta = {"_source_table": F.lit("things"), "_ingestion_method": F.lit(METHOD), "_source_updated_at": F.col("updated_at")}
    return ingest_keyset(spark, C, f"{place}/source", f"{place}/bronze", f"{place}/checkpoint", run_id, meta, **more)


def taken(spark, place):
    return sorted(r["b"] for r in read_bronze(spark, C, f"{place}/bronze").collect())


def crash_at(step):
    def fail(s):
        if s == step:
            raise RuntimeError(f"crash before {s}")

    return fail


def test_runs_take_in_what_is_new_in_one_job(spark, tmp_path):
    rows(spark, 0, 3000).repartition(5).write.parquet(f"{tmp_path}/source")
    got = run(spark, tmp_path)
    assert (got["status"], got["batches"], got["rows"], got["jobs"]) == ("run_completed", 1, 2999, 1)
    assert taken(spark, tmp_path) == list(range(1, 3000))
    assert run(spark, tmp_path)["status"] == "no_new_data"
    rows(spark, 3000, 500).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    rows(spark, 2999, 1).withColumn("b", F.lit(-1)).write.mode("append").parquet(f"{tmp_path}/source")  # below the cursor: seen as old
    got = run(spark, tmp_path)
    assert (got["batches"], got["rows"], got["jobs"]) == (1, 500, 1) and taken(spark, tmp_path) == list(range(1, 3500))
    raw = read_bronze(spark, C, f"{tmp_path}/bronze")
    assert raw.schema == C.bronze_schema() and raw.where("_source_updated_at <> updated_at or _ingested_at is null").isEmpty()
    assert raw.select("_ingestion_id", "_ingested_at").distinct().count() == 2


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_crash_costs_no_row_and_doubles_none(spark, tmp_path, step):
    rows(spark, 0, 40).repartition(3).write.parquet(f"{tmp_path}/source")
    with pytest.raises(Exception, match="crash before"):
        run(spark, tmp_path, fail=crash_at(step))
    rows(spark, 42, 10).write.mode("append").parquet(f"{tmp_path}/source")  # comes between crash and recovery
    got = run(spark, tmp_path)
    assert got["rows"] == 49 and got["batches"] == 2  # the crashed range as it was, then what came since
    assert taken(spark, tmp_path) == [*range(1, 40), *range(42, 52)]
    raw = read_bronze(spark, C, f"{tmp_path}/bronze")
    assert raw.where("_ingestion_id = 'r_batch_000001'").count() == 39


def reader(place, **more):
    o = {"path": str(place), "cursor": "updated_at,a,b", "initial": json.dumps(C.to_json(C.initial_watermark()))}
    return KeysetReader(o | more, C.schema().names)


def test_only_row_groups_of_the_range_are_read(spark, tmp_path):
    source = rows(spark, 1, 4000).repartitionByRange(20, "updated_at").sortWithinPartitions("updated_at")
    source.write.parquet(f"{tmp_path}/source")
    r = reader(f"{tmp_path}/source")
    top = r.latestOffset()
    want = source.agg(F.max(F.struct("updated_at", "a", "b"))).first()[0]
    assert (top["updated_at"], top["a"], top["b"]) == (want[0].strftime("%Y-%m-%dT%H:%M:%S.%f"), want[1], want[2])
    early = {"updated_at": (T0 + timedelta(minutes=1000)).strftime("%Y-%m-%dT%H:%M:%S.%f"), "a": "k3", "b": 0}
    late = {"updated_at": (T0 + timedelta(minutes=1010)).strftime("%Y-%m-%dT%H:%M:%S.%f"), "a": "k5", "b": 0}
    parts = r.partitions(early, late)
    assert 1 <= sum(len(p.groups) for p in parts) <= 2 < sum(len(p.groups) for p in r.partitions(r.initialOffset(), top)) == 20
    assert r.partitions(top, top) == []
    got = sorted(b for p in parts for batch in r.read(p) for b in batch.column("b").to_pylist())
    cursor = lambda x: F.struct(F.lit(x["updated_at"]).cast("timestamp_ntz").alias("updated_at"), F.lit(x["a"]).alias("a"), F.lit(x["b"]).alias("b"))
    at = F.struct("updated_at", "a", "b")
    assert got == sorted(r["b"] for r in source.where((at > cursor(early)) & (at <= cursor(late))).collect()) != []
    small = reader(f"{tmp_path}/source", taskbytes="1")
    assert len(small.partitions(r.initialOffset(), top)) == 20


def test_empty_sources(spark, tmp_path):
    rows(spark, 0, 1).write.parquet(f"{tmp_path}/source")  # a row without a time waits for one
    assert reader(f"{tmp_path}/source").latestOffset() == C.to_json(C.initial_watermark())
    assert run(spark, tmp_path)["status"] == "no_new_data"


def test_the_stream_is_a_plain_frame(spark, tmp_path):
    rows(spark, 0, 60).write.parquet(f"{tmp_path}/source")
    s = keyset_stream(spark, f"file://{tmp_path}/source", C.schema(), C.cursor, C.to_json(C.initial_watermark()))
    q = s.groupBy("note").count().writeStream.format("memory").queryName("notes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["note"], r["count"]) for r in spark.table("notes").collect()} == {(None, 29), ("é", 30)}


def test_a_row_group_is_unpacked_in_pieces(spark, tmp_path, monkeypatch):
    from quern.streaming import keyset

    rows(spark, 0, 300).coalesce(1).write.parquet(f"{tmp_path}/source")
    monkeypatch.setattr(keyset, "BATCH_ROWS", 70)
    start = C.to_json(C.initial_watermark())
    reader = KeysetReader({"path": f"{tmp_path}/source", "cursor": ",".join(C.cursor), "initial": json.dumps(start)}, C.schema().names)
    end = reader.latestOffset()
    (part,) = reader.partitions(start, end)
    pieces = [b.num_rows for b in reader.read(part)]
    assert max(pieces) <= 70 and sum(pieces) == 299 and end["updated_at"] == as_value(T0 + timedelta(minutes=99))
