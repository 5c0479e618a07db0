"""Time parameters and time columns; everything is UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROLLING = re.compile(r"(\d+)([dhm])")
_UNITS = {"d": "days", "h": "hours", "m": "minutes"}


def parse_when(text: str | None, *, now: datetime | None = None) -> datetime | None:
    """``7d`` / ``12h`` / ``30m``, ``today``, ``yesterday``, an ISO date or date-time, as UTC."""
    if text is None:
        return None
    now = now or datetime.now(UTC)
    now = now.replace(tzinfo=UTC) if now.tzinfo is None else now.astimezone(UTC)
    midnight = now.replace(hour=0, minute=0, second=0, microsecond=0)
    words = {"today": midnight, "yesterday": midnight - timedelta(days=1)}
    if text.lower() in words:
        return words[text.lower()]
    if rolling := _ROLLING.fullmatch(text):
        return now - timedelta(**{_UNITS[rolling[2]]: int(rolling[1])})
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"cannot read {text!r} as a time") from None
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def bound(df: DataFrame, column: str, value: datetime | str) -> Column:
    """A literal of the column's own type, so that the comparison reaches the file scan."""
    return F.lit(value).cast(df.schema[column].dataType)


def parse_ts(text: Column) -> Column:
    """ISO text with ``Z`` or an offset; without one it is UTC; unreadable text is NULL."""
    return F.try_to_timestamp(text)


DATE_TIME = r"^\d{4}-?\d{2}-?\d{2}[T ]\d{2}:?\d{2}"


def valid_datetime(text: Column) -> Column:
    """The text as a timestamp when it names a date and at least hours and minutes, else NULL."""
    return F.when(text.rlike(DATE_TIME), F.try_to_timestamp(text))


def ordered_window(first: Column, second: Column) -> tuple[Column, Column]:
    """Start and end that never run backwards; one missing side takes the other's value."""
    a, b = F.coalesce(first, second), F.coalesce(second, first)
    return F.least(a, b), F.greatest(a, b)


def collapse_backwards(start: Column, end: Column) -> tuple[Column, Column]:
    """Start moved to the end when it is missing or later, end filled from the start."""
    stop = F.coalesce(end, start)
    return F.when(start.isNull() | (start > stop), stop).otherwise(start), stop


def start_from_duration(end: Column, millis: Column) -> Column:
    """End minus a non-negative number of milliseconds; otherwise the end itself."""
    ms = millis.try_cast("bigint")
    return F.when(ms >= 0, F.timestamp_micros(F.unix_micros(end.cast("timestamp")) - ms * 1000)).otherwise(end)


def minus_parts(end: Column, secs: Column, nanos: Column) -> Column:
    """End minus ``{secs, nanos}``, at millisecond precision."""
    micros = F.coalesce(secs, F.lit(0)) * 1_000_000 + F.floor(F.coalesce(nanos, F.lit(0)) / 1000)
    return F.date_trunc("millisecond", F.timestamp_micros((F.unix_micros(end.cast("timestamp")) - micros).cast("bigint")))


def from_unix_seconds(seconds: Column, fallback: Column) -> Column:
    return F.coalesce(F.date_trunc("millisecond", F.timestamp_seconds(seconds)), fallback)


def iso_millis(ts: Column) -> Column:
    """ISO text with milliseconds and ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
