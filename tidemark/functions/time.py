"""Time buckets, parsing, formatting and window arithmetic on timestamps without zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET = "2 hours"
BUCKET_SECONDS = 7200
SNAPSHOT_FORMAT = "yyyy-MM-dd-HH:mm:ss"
GUID_FORMAT = "yyyyMMddHHmmss"

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
# 2000-01-03 00:00:00, a Monday, as seconds since 1970: the bucket grid starts there.
_GRID_ORIGIN = 946857600


def width_seconds(width: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s*", width)
    if not m or int(m.group(1)) == 0:
        raise ValueError(f"not a fixed bucket width: {width!r}")
    return int(m.group(1)) * _UNIT_SECONDS[m.group(2)]


def time_bucket(width: str, ts: Column) -> Column:
    """Start of the bucket holding ``ts``, on the grid that starts at 2000-01-03.

    Spark allows one ``window`` per projection: bucket once per ``select`` and reuse the column.
    """
    seconds = width_seconds(width)
    offset = _GRID_ORIGIN % seconds
    return F.window(ts, f"{seconds} seconds", f"{seconds} seconds", f"{offset} seconds")["start"]


def bucket_floor(ts: Column) -> Column:
    return time_bucket(BUCKET, ts)


def bucket_ceil(ts: Column) -> Column:
    start = bucket_floor(ts)
    return F.when(start == ts, start).otherwise(start + F.expr(f"INTERVAL '{BUCKET_SECONDS}' SECOND"))


def parse_ts(s: Column) -> Column:
    """``2024-01-31-23:59:59`` or an ISO date/date-time without zone; anything else is null."""
    text = F.regexp_replace(
        s, r"^(\d{4}-\d{1,2}-\d{1,2})-(\d{1,2}:\d{1,2}:\d{1,2})$", "$1 $2")
    iso = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?)?$")
    # An hour without minutes is ISO, but no timestamp literal.
    text = F.regexp_replace(text, r"([T ]\d{1,2})$", "$1:00")
    return F.when(iso, text.try_cast("timestamp_ntz"))


def format_ts(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, fmt)


def iso_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def shift_days(ts: Column, days: int) -> Column:
    return ts + F.expr(f"INTERVAL '{int(days)}' DAY")


def snapshot_id(ts: Column) -> Column:
    """One id per cycle, written from the cycle's own time."""
    return F.date_format(ts, GUID_FORMAT)


def ntz(literal) -> Column:
    return F.lit(str(literal)).cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def in_window(ts: Column, start, end) -> Column:
    """Half-open ``[start, end)``: two plain comparisons, so they reach the scan."""
    return (ts >= ntz(start)) & (ts < ntz(end))


def on_date(ts: Column, day: str) -> Column:
    """Calendar-day equality as a range: unlike a formatted comparison it prunes."""
    start = ntz(day)
    return (ts >= start) & (ts < start + F.expr("INTERVAL '1' DAY"))
