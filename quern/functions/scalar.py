"""Scalar expressions that several models share."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Ho_Chi_Minh"
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def date_key(c: Column | str) -> Column:
    """YYYYMMDD as a number; null stays null."""
    d = F.to_date(F.col(c) if isinstance(c, str) else c)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def iso_weekday(d: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(d) + 1).cast("int")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, rounded half up."""
    return F.round((micros(later) - micros(earlier)).cast("decimal(20,0)") / F.lit(1_000_000), 0).cast("long")


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours with two decimals, rounded half up; negative if `later` is earlier."""
    return F.round((micros(later) - micros(earlier)).cast("decimal(20,0)") / F.lit(3_600_000_000), 2).cast("decimal(18,2)")


def path_date(path: Column, key: str = "event_date") -> Column:
    """The date of a `key=YYYY-MM-DD` folder in a path, null without one."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, rf"{key}=(\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit("")))


def path_value(path: Column, key: str = "ingestion_id") -> Column:
    return F.nullif(F.regexp_extract(path, rf"{key}=([^/]+)", 1), F.lit(""))


def local_to_utc(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.to_utc_timestamp(ts, zone)


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def safe_run_id(run_id: str) -> str:
    """A run id that can be a folder name."""
    return re.sub(r'[<>"/\\|?*]', "_", run_id.replace(":", "-").replace("+", "_"))


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def quoted(name: str, mark: str = "`") -> str:
    """An identifier quoted for SQL, whatever it holds; dots are part of it."""
    return mark + name.replace(mark, mark * 2) + mark


def request_id(*parts: str) -> str:
    """The same id for the same request, however often it is made."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, ":".join(parts)))


def request_id_of(*parts: Column) -> Column:
    """The same id as a column: the name-based UUID of the parts with colons between, made of SHA-1. Null if a part is."""
    name = F.concat(*[x for p in parts for x in (F.lit(":"), p.cast("string"))][1:])
    digest = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def windows(start: date, end: date, days: int = 30) -> list[tuple[date, date]]:
    """Consecutive inclusive windows of at most `days` days from start to end."""
    if days < 1 or end < start:
        raise ValueError("a window needs a day and an end that is not before its start")
    out = []
    while start <= end:
        last = min(start + timedelta(days=days - 1), end)
        out.append((start, last))
        start = last + timedelta(days=1)
    return out


def window_rows(start: Column, end: Column, days: int = 30) -> Column:
    """The same windows as rows: explode of (window_start, window_end)."""
    starts = F.sequence(start, end, F.make_dt_interval(F.lit(days)))
    return F.explode(F.transform(starts, lambda s: F.struct(s.alias("window_start"), F.least(F.date_add(s, days - 1), end).alias("window_end"))))
