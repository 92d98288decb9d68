"""Data-quality checks as data frames: one row for a check, or one row for each violation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import any_null


class QualityError(ValueError):
    """A check failed; the message names the checks and their counts."""


def counters(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """(check_name, failures): how many rows meet each condition, all in one pass. No rows give 0."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("failures")) for n in checks])).alias("c")).select("c.*")


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return counters(df, {f"not_null_{c}": F.col(c).isNull() for c in columns})


def null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(any_null(keys))


def duplicates(df: DataFrame, keys: Sequence[str], name: str = "copies") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def unique(df: DataFrame, keys: Sequence[str], check: str) -> DataFrame:
    """Keys that occur more than once; rows with a null key are not looked at."""
    return duplicates(df.where(~any_null(keys)), keys).agg(F.lit(f"unique_{check}").alias("check_name"), F.count(F.lit(1)).alias("failures"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values of a child's column that the parent lacks; nulls are no orphans."""
    p = parent.select(F.col(parent_column).alias("__p"))
    c = child.where(F.col(column).isNotNull())
    return c.join(p, c[column] == p["__p"], "left_anti")


def relationship(child: DataFrame, column: str, parent: DataFrame, parent_column: str, check: str) -> DataFrame:
    return orphans(child, column, parent, parent_column).agg(F.lit(f"relationship_{check}").alias("check_name"), F.count(F.lit(1)).alias("failures"))


def relationships(child: DataFrame, parents: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(check_name, failures) of several foreign keys of one child, which is read once. parents: (column, parent, its column, check).

    Nulls are no orphans. Each parent is joined by its different keys; small ones are broadcast by Spark.
    """
    rows = child.select(*dict.fromkeys(c for c, _, _, _ in parents))
    checks = {}
    for i, (column, parent, key, check) in enumerate(parents):
        keys = parent.select(F.col(key).alias(f"__key{i}")).where(F.col(f"__key{i}").isNotNull()).distinct().withColumn(f"__there{i}", F.lit(True))
        rows = rows.join(keys, F.col(column) == F.col(f"__key{i}"), "left")
        checks[f"relationship_{check}"] = F.col(column).isNotNull() & F.col(f"__there{i}").isNull()
    return counters(rows, checks)


def all_checks(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def conflicts(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys with several different value rows. A null is a value here, which counting distinct columns would miss."""
    return df.groupBy(*keys).agg(F.countDistinct(F.struct(*values)).alias("versions")).where("versions > 1")


def reconciled(totals: DataFrame, parts: DataFrame, key: str, total: str, part: str, tolerance: str = "0.01") -> DataFrame:
    """Keys whose total differs from the sum of its parts; no parts sum to 0."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("part_sum"))
    return totals.join(sums, key, "left").select(key, F.col(total).alias("total"), F.coalesce("part_sum", F.lit(0)).alias("part_sum")).where(F.abs(F.col("total") - F.col("part_sum")) > F.lit(tolerance).cast("decimal(10,2)"))


def require_clean(checks: DataFrame) -> None:
    """Raises if a check has failures. The frame has a row for a check, so little reaches the driver."""
    bad = checks.where("failures > 0").collect()
    if bad:
        raise QualityError(", ".join(f"{r['check_name']}={r['failures']}" for r in bad))


def require_same_count(a: DataFrame, b: DataFrame, what: str) -> None:
    x, y = a.count(), b.count()
    if x != y:
        raise QualityError(f"{what}: {x} rows against {y}")


def require_zero(failures: Mapping[str, int]) -> None:
    """Raises for checks whose counts were taken while rows were written."""
    if bad := {k: n for k, n in failures.items() if n}:
        raise QualityError(", ".join(f"{k}={n}" for k, n in bad.items()))


def click_conditions(source_date: str = "_source_event_date") -> dict[str, Column]:
    """What is wrong with an event. Rows without a source date pass the date check."""
    return {
        "null_session_id": F.col("session_id").isNull(), "null_event_timestamp": F.col("event_timestamp").isNull(), "null_item_id": F.col("item_id").isNull(),
        "blank_category": F.col("category").isNull() | (F.trim("category") == ""), "wrong_event_date": F.col("event_date") != F.col(source_date),
    }


def click_checks(df: DataFrame, source_date: str = "_source_event_date") -> DataFrame:
    return counters(df, click_conditions(source_date))


def weather_range_checks(df: DataFrame) -> DataFrame:
    h, p, w = F.col("relative_humidity_2m"), F.col("precipitation"), F.col("wind_speed_10m")
    return counters(df, {"humidity_out_of_range": (h < 0) | (h > 100), "negative_precipitation": p < 0, "negative_wind": w < 0, "null_temperature": F.col("temperature_2m").isNull()})


# Names of null counters by column.
FORECAST_NULLS = {"warehouse_id": "null_warehouse", "ingestion_id": "null_ingestion", "forecast_time": "null_time"}
HISTORY_NULLS = {
    "warehouse_id": "null_warehouse", "ingestion_id": "null_ingestion", "weather_time": "null_time", "retrieved_at": "null_retrieved", "window_start": "null_start", "window_end": "null_end", "temperature_2m": "null_temp",
    "relative_humidity_2m": "null_humidity", "precipitation": "null_precip", "wind_speed_10m": "null_wind", "weather_code": "null_code",
}


def weather_checks(df: DataFrame, nulls: Mapping[str, str], more: Mapping[str, Column]) -> DataFrame:
    """Null counters, counters of values that can't be, and some more, in one pass. A null is no value out of range; its own counter has it."""
    h, p, w = F.col("relative_humidity_2m"), F.col("precipitation"), F.col("wind_speed_10m")
    # fixed values: names of the range counters
    ranges = {"humidity_below_0": h < 0, "humidity_above_100": h > 100, "negative_precip": p < 0, "negative_wind": w < 0}
    return counters(df, {n: F.col(c).isNull() for c, n in nulls.items()} | ranges | dict(more))


def forecast_checks(df: DataFrame, units: int, hours: int = 48) -> DataFrame:
    """The nine failures of forecast hours: nulls, ranges, repeated grain, and rows that aren't `hours` for each unit."""
    grain = duplicates(df, ["warehouse_id", "ingestion_id", "forecast_time"]).agg(F.lit("duplicate_grain").alias("check_name"), F.count(F.lit(1)).alias("failures"))
    rows = df.agg(F.lit("row_count").alias("check_name"), (F.count(F.lit(1)) != hours * units).cast("long").alias("failures"))
    return all_checks(rows, weather_checks(df, FORECAST_NULLS, {}), grain)


def history_checks(df: DataFrame) -> DataFrame:
    """The sixteen counters of past hours."""
    return weather_checks(df, HISTORY_NULLS, {"invalid_window": F.col("window_start") > F.col("window_end")})


def history_completeness(rows: DataFrame, metadata: DataFrame, expected: DataFrame) -> DataFrame:
    """The five failures of ingestions against what was to be taken in.

    expected: (ingestion_id). An ingestion without any hour, which leaves no row, is a missing one; nothing reaches the driver.
    """
    window = F.datediff(F.to_date("request_params.end_date"), F.to_date("request_params.start_date")) + 1
    due = metadata.dropDuplicates(["ingestion_id"]).select("ingestion_id", (window * 24).cast("long").alias("expected_rows"), F.lit(True).alias("has_metadata"))
    actual = rows.groupBy("ingestion_id").agg(F.count(F.lit(1)).alias("actual_rows"), F.countDistinct("weather_time").alias("hours"))
    every = expected.select("ingestion_id").distinct().withColumn("wanted", F.lit(True)).join(due, "ingestion_id", "full").join(actual, "ingestion_id", "full")
    wanted, known, there = F.col("wanted").isNotNull(), F.col("has_metadata").isNotNull(), F.col("actual_rows").isNotNull()
    off = (F.col("actual_rows") != F.col("expected_rows")) | (F.col("hours") != F.col("expected_rows"))
    one = every.agg(
        F.count_if(wanted & ~known).alias("missing_metadata"), F.count_if(wanted & ~there).alias("missing_ingestions"), F.count_if(there & ~wanted).alias("unexpected_ingestions"),
        F.count_if(F.coalesce(there & off, F.lit(False))).alias("invalid_row_counts"),
        (F.coalesce(F.sum("expected_rows"), F.lit(0)) != F.coalesce(F.sum("actual_rows"), F.lit(0))).cast("long").alias("total_row_mismatch"),
    )
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).alias("failures")) for n in one.columns])).alias("c")).select("c.*")


def completeness(df: DataFrame, keys: Sequence[str], hour: str, expected: Column) -> DataFrame:
    """Ingestions whose rows or different hours aren't as many as expected. `expected` is an aggregate expression."""
    got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual_rows"), F.countDistinct(hour).alias("actual_hours"), expected.alias("expected_hours"))
    return got.where((F.col("actual_rows") != F.col("expected_hours")) | (F.col("actual_hours") != F.col("expected_hours")))


@dataclass(frozen=True)
class Statuses:
    """What the statuses of orders stand for; tables with other codes bring their own."""

    known: tuple[str, ...] = ("created", "approved", "processing", "shipped", "delivered", "canceled", "unavailable", "invoiced")
    unapproved: tuple[str, ...] = ("created",)
    delivered: tuple[str, ...] = ("delivered",)
    canceled: tuple[str, ...] = ("canceled",)
    #: Statuses that an order may have at all where rules on orders hold.
    listed: tuple[str, ...] = ("created", "approved", "processing", "shipped", "delivered", "canceled", "unavailable", "invoiced")


def order_time_checks(orders: DataFrame, statuses: Statuses = Statuses()) -> DataFrame:
    """Which lifecycle times a status needs or forbids, and their order."""
    s, bought, approved, carrier, delivered = (F.col(c) for c in ("order_status", "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"))
    done = s.isin(*statuses.delivered)
    return counters(orders, {
        "pending_with_approval": s.isin(*statuses.unapproved) & approved.isNotNull(), "open_with_delivery": ~done & delivered.isNotNull(), "finished_without_delivery": done & delivered.isNull(),
        "approved_before_purchase": approved < bought, "carrier_before_approval": carrier < approved, "delivered_before_carrier": delivered < carrier, "delivered_before_purchase": delivered < bought, "unknown_status": ~s.isin(*statuses.known),
    })


def order_rules(orders: DataFrame, items: DataFrame, payments: DataFrame, statuses: Statuses = Statuses()) -> DataFrame:
    """(check_name, failures): orders without lines, with other than one payment, with lines of other warehouses, of unknown origin, or paid for another amount than their lines come to."""
    lines = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("price") * F.col("quantity") + F.col("freight_value")).alias("due"), F.min("warehouse_id").alias("first_warehouse"), F.max("warehouse_id").alias("last_warehouse"))
    paid = payments.groupBy("order_id").agg(F.count(F.lit(1)).alias("payments"), F.sum("payment_value").alias("paid"))
    o = orders.select("order_id", "warehouse_id", "order_status").join(lines, "order_id", "left").join(paid, "order_id", "left")
    return counters(o, {
        "order_without_lines": F.col("lines").isNull(), "not_one_payment": F.coalesce("payments", F.lit(0)) != 1, "other_warehouse": F.col("lines").isNotNull() & ~(F.col("warehouse_id").eqNullSafe(F.col("first_warehouse")) & F.col("warehouse_id").eqNullSafe(F.col("last_warehouse"))),
        "status_not_listed": ~F.col("order_status").isin(*statuses.listed), "paid_other_amount": F.abs(F.coalesce("paid", F.lit(0)) - F.coalesce("due", F.lit(0))) > F.lit("0.01").cast("decimal(10,2)"),
    })


def coverage(bronze: DataFrame, keys: Sequence[str], cursor: Sequence[str]) -> DataFrame:
    """(rows, different_keys, and the largest cursor) of a raw table, in one pass; a key with a null part is a key."""
    top = F.max(F.struct(*cursor))
    return bronze.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.struct(*keys)).alias("different_keys"), *[top[c].alias(f"top_{c}") for c in cursor])
