"""Hourly weather from responses with parallel arrays to rows in UTC, and the resolution of overlapping windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import local_to_utc, path_value

from .versions import latest

# Fields of the payload and of its metadata.
HOURLY = ("time", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "weather_code")
VALUES = HOURLY[1:]
RESPONSE_SCHEMA = (
    "latitude double, longitude double, generationtime_ms double, utc_offset_seconds int, timezone string, timezone_abbreviation string, elevation double, "
    "hourly_units struct<time:string,temperature_2m:string,relative_humidity_2m:string,precipitation:string,wind_speed_10m:string,weather_code:string>, "
    "hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<int>,precipitation:array<double>,wind_speed_10m:array<double>,weather_code:array<int>>"
)
METADATA_SCHEMA = (
    "version int, source_name string, api_type string, warehouse_id string, run_id string, ingestion_id string, logical_at string, requested_at string, requested_latitude double, requested_longitude double, "
    "response_latitude double, response_longitude double, endpoint string, http_status int, request_params struct<start_date:string,end_date:string,timezone:string>"
)

COORDINATES = ("requested_latitude", "requested_longitude", "response_latitude", "response_longitude")


def with_ingestion_id(responses: DataFrame) -> DataFrame:
    return responses.withColumn("ingestion_id", path_value(F.col("_metadata.file_path")))


def exploded(responses: DataFrame) -> DataFrame:
    """A row for each hour: (ingestion_id, time and values). Arrays of unequal length are refused, as padding would hide them."""
    sizes = [F.size(f"hourly.{c}") for c in HOURLY]
    equal = sizes[0] == sizes[0]
    for s in sizes[1:]:
        equal = equal & (s == sizes[0])
    checked = responses.withColumn("__zipped", F.when(equal, F.arrays_zip(*[f"hourly.{c}" for c in HOURLY])).otherwise(F.raise_error(F.lit("hourly arrays of unequal length"))))
    return checked.select("ingestion_id", F.explode("__zipped").alias("h")).select("ingestion_id", *[F.col(f"h.{c}").alias(c) for c in HOURLY])


def hours_of(responses: DataFrame, metadata: DataFrame, time: str, said: Mapping[str, Column]) -> DataFrame:
    """A row for each hour of each response, its time as `time` in UTC, with the place and what the metadata (one row for each response) says: columns by name."""
    m = metadata.select("ingestion_id", "warehouse_id", *[c.alias(n) for n, c in said.items()], *COORDINATES)
    at = local_to_utc(F.to_timestamp("time")).alias(time)
    return exploded(responses).join(m, "ingestion_id", "left").select("warehouse_id", "ingestion_id", *said, at, *VALUES, *COORDINATES)


def forecast_silver(responses: DataFrame, metadata: DataFrame) -> DataFrame:
    """Forecast hours with the snapshot they belong to."""
    return hours_of(responses, metadata, "forecast_time", {"snapshot_at": F.to_timestamp("logical_at"), "retrieved_at": F.to_timestamp("requested_at")})


def history_silver(responses: DataFrame, metadata: DataFrame) -> DataFrame:
    """Past hours with the window that they were asked for in."""
    window = {f"window_{x}": F.to_date(f"request_params.{x}_date") for x in ("start", "end")}
    return hours_of(responses, metadata, "weather_time", {"retrieved_at": F.to_timestamp("requested_at")} | window)


def resolved(history: DataFrame) -> DataFrame:
    """One row for each warehouse and hour where windows overlap: the one retrieved last."""
    return latest(history, ["warehouse_id", "weather_time"], ["retrieved_at", "ingestion_id", *VALUES])


def expected_hours() -> object:
    """Hours of a window of whole days, as an aggregate for `quality.completeness`."""
    return (F.datediff(F.max("window_end"), F.max("window_start")) + 1) * 24
