"""Daily click measures that add up: each increment of events leaves a state, and days are folded from the states of their increments.

Distinct sessions and items of a day are bitmaps, one for each 32,768 ids of a range that occurs, so a further increment is an OR and
the counts stay exact; categories, which are words, are kept as they are, a row for each of a day. Sessions keep their ends, of which the
least and the largest count. An increment is read once for each of these and none of them multiplies its rows; earlier increments are
not read again, and a day is folded without the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalar import checked_identifier, date_key, seconds_between
from quern.storage import Files

#: What of events is counted by bitmap, by column; ids are whole numbers.
COUNTED = {"sessions": "session_id", "items": "item_id"}


def bitmaps(events: DataFrame, column: str) -> DataFrame:
    """(event_date, bucket, bits) of the ids of each day; null ids don't count."""
    ids = events.where(F.col(column).isNotNull()).select("event_date", F.bitmap_bucket_number(column).alias("bucket"), F.bitmap_bit_position(column).alias("at"))
    return ids.groupBy("event_date", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def spans(events: DataFrame) -> DataFrame:
    ts = F.col("event_timestamp")
    return events.groupBy("session_id").agg(F.min(ts).alias("start_at"), F.max(ts).alias("end_at"), F.min("event_date").alias("event_date"))


#: How the states of increments fold into one, by kind: keys, and an aggregate of each other column.
FOLDS: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "events": (("event_date",), {"event_count": "sum"}),
    "sessions": (("event_date", "bucket"), {"bits": "bitmap_or_agg"}),
    "items": (("event_date", "bucket"), {"bits": "bitmap_or_agg"}),
    "categories": (("event_date", "category"), {}),
    "spans": (("session_id",), {"start_at": "min", "end_at": "max", "event_date": "min"}),
}


def state_of(events: DataFrame) -> dict[str, DataFrame]:
    """The state that an increment leaves, by kind."""
    return {
        "events": events.groupBy("event_date").agg(F.count(F.lit(1)).alias("event_count")),
        **{kind: bitmaps(events, column) for kind, column in COUNTED.items()},
        "categories": events.where("category is not null").select("event_date", "category").distinct(),
        "spans": spans(events),
    }


def folded(states: DataFrame, kind: str) -> DataFrame:
    keys, values = FOLDS[kind]
    if not values:
        return states.select(*keys).distinct()
    return states.groupBy(*keys).agg(*[getattr(F, f)(c).alias(c) for c, f in values.items()])


@dataclass
class DailyStates:
    """States in a folder, one part for each increment. An increment that is added again replaces its part."""

    spark: SparkSession
    path: str

    def add(self, events: DataFrame, increment: str) -> None:
        for kind, df in state_of(events).items():
            df.write.mode("overwrite").parquet(f"{self.path}/{kind}/increment={checked_identifier(increment)}")

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}").drop("increment")

    def increments(self) -> list[str]:
        return [n.removeprefix("increment=") for n in Files(self.spark).names(f"{self.path}/{list(FOLDS)[-1]}") if n.startswith("increment=")]

    def daily(self, days: Sequence[date] | None = None) -> DataFrame:
        """The daily aggregate, of all days or of some, whose states alone are read; `sessions_started` is null where no session started."""

        def of(kind: str) -> DataFrame:
            states = self.read(kind)
            # a session's first day is only known when it is folded
            return folded(states if days is None or kind == "spans" else states.where(F.col("event_date").isin(list(days))), kind)

        def distinct(kind: str, name: str) -> DataFrame:
            return of(kind).groupBy("event_date").agg(F.sum(F.bitmap_count("bits")).alias(name))

        started = of("spans").withColumn("seconds", seconds_between(F.col("end_at"), F.col("start_at")))
        started = started.groupBy("event_date").agg(F.count(F.lit(1)).alias("sessions_started"), F.avg("seconds").alias("avg_session_duration_seconds"))
        out = of("events")
        parts = [distinct("sessions", "active_session_count"), distinct("items", "distinct_item_count"), of("categories").groupBy("event_date").agg(F.count(F.lit(1)).alias("distinct_category_count"))]
        for part in parts:
            counted = next(c for c in part.columns if c != "event_date")
            out = out.join(part.withColumnRenamed("event_date", "__d"), same_day(), "left").drop("__d").withColumn(counted, F.coalesce(counted, F.lit(0).cast("long")))
        return out.join(started, "event_date", "left").select(
            date_key("event_date").alias("date_key"), "event_date", "sessions_started", "active_session_count", "event_count", "distinct_item_count", "distinct_category_count", "avg_session_duration_seconds"
        )


def same_day() -> Column:
    return F.col("event_date").eqNullSafe(F.col("__d"))
