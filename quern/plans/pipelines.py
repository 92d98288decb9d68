"""Domain pipelines from raw folders to serving tables. Every step can be run again without an effect of its own."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import METADATA, contract_of
from quern.operators import clickstream as C
from quern.operators import quality as Q
from quern.operators import versions as R
from quern.operators import weather as H
from quern.sources.readers import committed_units, read_bronze, read_metadata, read_responses
from quern.partitioned import PartitionedTable, by_month
from quern.storage import Files, SnapshotTable, digests, load_staging, same_as_served

#: Changes of a table between raw and cleaned layer, by table.
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {"orders": lambda df: df.withColumn("order_purchase_date", F.to_date("order_purchase_timestamp"))}


#: What tells the partition of a row, by table: something that stays the same for a key.
PARTITIONS: dict[str, str] = {"orders": "order_purchase_timestamp"}
#: Buckets of the key that other cleaned tables are dealt out by when they are made.
BUCKETS = 16


def since(spark: SparkSession, name: str, bronze: str, last: datetime | None) -> DataFrame | None:
    """Raw rows of a table that came at `last` or later; only folders from that day on are read. None if there is none."""
    c = contract_of(name)
    if last is None:
        return read_bronze(spark, c, bronze)
    days = [d for d in Files(spark).names(f"{bronze}/{name}") if d.startswith("ingestion_date=") and d.split("=", 1)[1] >= str(last.date())]
    if not days:
        return None
    df = spark.read.schema(c.bronze_schema()).option("recursiveFileLookup", True).parquet(*[f"{bronze}/{name}/{d}" for d in days])
    return df.select(*c.columns, *METADATA).where(F.col("_ingested_at") >= F.lit(last))


def cleaned(spark: SparkSession, name: str, silver: str) -> PartitionedTable | None:
    """The cleaned table of those that are dealt out by a column of their own."""
    if name not in PARTITIONS:
        return None
    c = contract_of(name)
    rows = TRANSFORMS.get(name, lambda df: df)(spark.createDataFrame([], c.bronze_schema()))
    schema = rows.withColumn("_silver_processed_at", F.current_timestamp()).schema
    return PartitionedTable(spark, f"{silver}/{name}", schema, c.key, by_month(PARTITIONS[name]))


def silver_rows(spark: SparkSession, name: str, silver: str) -> DataFrame:
    return (cleaned(spark, name, silver) or SnapshotTable(spark, f"{silver}/{name}")).read()


def silver_table(spark: SparkSession, name: str, bronze: str, silver: str, buckets: int = BUCKETS, now: Callable[[], Column] = F.current_timestamp) -> int:
    """Latest version of each key merged into the cleaned table; returns the number of rows that changed.

    What has come since the table's last ingestion time is read, and only the partitions, or else the buckets of keys, that it meets
    are read and written; only those are checked.
    """
    c = contract_of(name)
    parts, table = cleaned(spark, name, silver), SnapshotTable(spark, f"{silver}/{name}")
    have = parts or table
    last = have.read().agg(F.max("_ingested_at")).first()[0] if have.exists() else None
    raw = since(spark, name, bronze, last)
    if raw is None:
        return 0
    state = TRANSFORMS.get(name, lambda df: df)(R.latest_state(raw, c.key)).withColumn("_silver_processed_at", now())
    if parts:
        return parts.merge(state).applied  # keys are looked at while rows are written, and can't repeat
    return table.merge(state, c.key, buckets=buckets, check=lambda rows: Q.require_clean(Q.all_checks(Q.not_null(rows, c.key), Q.unique(rows, c.key, name))))


def serve_table(spark: SparkSession, name: str, silver: str, staging: str) -> str:
    return load_staging(silver_rows(spark, name, silver), SnapshotTable(spark, f"{staging}/{name}"), contract_of(name).key)


def operational(spark: SparkSession, names: Sequence[str], bronze: str, silver: str, staging: str) -> dict[str, int]:
    changed = {n: silver_table(spark, n, bronze, silver) for n in names}
    for n in names:
        serve_table(spark, n, silver, staging)
    return changed


def click_events(spark: SparkSession, bronze: str, silver: str, partitions: int = 128) -> int:
    """Events of files that the cleaned table hasn't seen; returns the number of rows taken in.

    Raw folders are named by ingestion id; an anti join with the log of files leaves the new ones, so what reaches the driver is new.
    Events are written once, by date, and checked and counted while they are written; then the log takes the files. A crash in between shows
    in the version that the log has noted, and the files of the new folders are then looked up in the table itself.
    """
    table, log = SnapshotTable(spark, silver), SnapshotTable(spark, f"{silver}_files")
    known = log.read() if log.exists() else None
    folders = raw_folders(spark, bronze)
    if not folders:
        return 0
    named = spark.createDataFrame([(d, d.rsplit("ingestion_id=", 1)[-1]) for d in folders], "folder string, _ingestion_id string")
    if known is not None:
        named = named.join(known.select("_ingestion_id"), "_ingestion_id", "left_anti")
    new = sorted(r["folder"] for r in named.select("folder").collect())
    if not new:
        return 0
    raw = spark.read.parquet(*new)
    files = raw.select("_source_file_path", "_source_file_etag", "_ingestion_id").distinct()
    noted = known.agg(F.max("version")).first()[0] if known is not None else 0
    if known is not None:
        changed = C.changed_sources(files, known)
        if not changed.isEmpty():
            raise ValueError(f"a source file has changed: {changed.first()['_source_file_path']}")
    crashed = table.exists() and table.version() != noted
    if crashed:
        raw = C.of_sources(raw, C.new_sources(files, table.read()))
    n = 0
    if not raw.isEmpty():
        spread = C.typed_events(raw).repartition(partitions, "event_date", F.pmod(F.xxhash64("session_id"), F.lit(16)))
        kept = spread.withColumn("event_date", F.coalesce("event_date", "_source_event_date"))
        measures = {k: F.count_if(F.coalesce(c, F.lit(False))) for k, c in Q.click_conditions().items()} | {"rows": F.count(F.lit(1))}
        n = table.append_measured(kept, measures, lambda got: Q.require_zero({k: v for k, v in got.items() if k != "rows"}), ["event_date"])["rows"]
    log.append(files.select("_source_file_path", "_source_file_etag", "_ingestion_id", F.lit(table.version()).alias("version")))
    if crashed:  # some of the files were in the table already
        n = table.read().join(F.broadcast(files.select("_ingestion_id")), "_ingestion_id", "left_semi").count()
    return n


def raw_folders(spark: SparkSession, bronze: str) -> list[str]:
    """Folders of ingestions that have been written whole."""
    return [d for d in Files(spark).walk(bronze, "_SUCCESS") if "ingestion_id=" in d]


def serve_clicks(spark: SparkSession, silver: str, staging: str) -> str:
    """LOADED, or NO_OP if the very rows are served already. What is served is checked in either case, while it is written or as it lies there."""
    rows = SnapshotTable(spark, silver).read().select("session_id", "event_timestamp", "event_date", "item_id", "category")
    target = SnapshotTable(spark, staging)
    bad = {f"not_null_{c}": F.col(c).isNull() for c in ("session_id", "event_timestamp", "event_date", "item_id")} | {"blank_category": F.col("category").isNull() | (F.trim("category") == "")}
    if same_as_served(rows, target):
        Q.require_clean(Q.counters(target.read(), bad))
        return "NO_OP"
    measures = digests(rows.columns) | {k: F.count_if(F.coalesce(c, F.lit(False))) for k, c in bad.items()}
    target.overwrite(rows, None, measures, lambda got: Q.require_zero({k: got[k] for k in bad}))
    return "LOADED"


# Keys of the served weather tables.
WEATHER_GRAIN = {"forecast": ("warehouse_id", "ingestion_id", "forecast_time"), "historical": ("warehouse_id", "weather_time")}


def serve_weather(spark: SparkSession, kind: str, silver: str, staging: str) -> str:
    """A cleaned weather table for serving: as many rows, no null or repeated grain, promoted in one step."""
    return load_staging(SnapshotTable(spark, silver).read(), SnapshotTable(spark, staging), WEATHER_GRAIN[kind])


def weather_forecast(spark: SparkSession, root: str, silver: str, hours: int = 48) -> int:
    """Committed units that the table doesn't have; returns how many."""
    table = SnapshotTable(spark, silver)
    done = {r[0] for r in table.read().select("ingestion_id").distinct().collect()} if table.exists() else set()  # a row a unit
    new = [u for u in committed_units(spark, f"{root}/forecast") if u.rsplit("ingestion_id=", 1)[1] not in done]
    if not new:
        return 0
    rows = H.forecast_silver(read_responses(spark, new), read_metadata(spark, new))
    table.append(rows, lambda w: Q.require_clean(Q.forecast_checks(w, len(new), hours)))
    return len(new)


def weather_history(spark: SparkSession, root: str, silver: str, control: str) -> int:
    """Windows that the control table doesn't have: checked, conflicts refused, overlaps resolved, merged, then noted as done."""
    table, log = SnapshotTable(spark, silver), SnapshotTable(spark, control)
    done = {r[0] for r in log.read().select("ingestion_id").collect()} if log.exists() else set()
    new = [u for u in committed_units(spark, f"{root}/history") if u.rsplit("ingestion_id=", 1)[1] not in done]
    if not new:
        return 0
    metadata = read_metadata(spark, new)
    rows = H.history_silver(read_responses(spark, new), metadata)
    due = spark.createDataFrame([(u.rsplit("ingestion_id=", 1)[1],) for u in new], "ingestion_id string")
    Q.require_clean(Q.all_checks(Q.history_checks(rows), Q.history_completeness(rows, metadata, due)))
    if not Q.conflicts(rows, ["warehouse_id", "weather_time"], H.VALUES).isEmpty():
        raise Q.QualityError("windows that overlap disagree")
    table.merge(H.resolved(rows), ["warehouse_id", "weather_time"], "retrieved_at", "retrieved_at")
    log.insert_new(rows.select("ingestion_id", "warehouse_id", "window_start", "window_end", "retrieved_at").distinct(), ["ingestion_id"])
    return len(new)


def in_order(steps: Mapping[str, tuple[Sequence[str], Callable[[dict], object]]]) -> dict[str, object]:
    """Runs steps after those that they name; each gets the results so far."""
    done: dict[str, object] = {}
    while left := [k for k in steps if k not in done]:
        ready = [k for k in left if reduce(lambda ok, d: ok and d in done, steps[k][0], True)]
        if not ready:
            raise ValueError(f"steps wait for each other: {left}")
        for k in ready:
            done[k] = steps[k][1](done)
    return done
