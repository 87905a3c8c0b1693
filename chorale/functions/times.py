"""Epoch seconds, ISO stamps and relative time windows, independent of the session time zone."""

from __future__ import annotations

import calendar
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# The relative windows a search accepts.
WINDOWS = ("hour", "day", "week", "month", "year", "all")
_FIXED_SPAN = {"hour": timedelta(hours=1), "day": timedelta(days=1), "week": timedelta(weeks=1)}


def iso_utc(seconds: Column) -> Column:
    """`2024-01-01T00:00:00+00:00`; microseconds appear only when there are any."""
    moment = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    shown = F.translate(moment.cast("string"), " ", "T")
    shown = F.when(F.length(shown) > 19, F.rpad(shown, 26, "0")).otherwise(shown)
    return F.concat(shown, F.lit("+00:00"))


def utc_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


def window_start(as_of: datetime, window: str) -> datetime | None:
    """Start of the window that ends at `as_of`; None for the unbounded window."""
    if window not in WINDOWS:
        raise ValueError(f"window must be one of {WINDOWS}")
    if window == "all":
        return None
    if window in _FIXED_SPAN:
        return as_of - _FIXED_SPAN[window]
    months = as_of.year * 12 + as_of.month - 1 - (12 if window == "year" else 1)
    year, month = divmod(months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return as_of.replace(year=year, month=month + 1, day=min(as_of.day, last))


def within_window(column: Column, as_of: datetime, window: str, epoch: bool = True) -> Column:
    """From the window's start to `as_of`, both included; `all` has no start.

    Bare column against literals, so the test reaches the scan. `epoch`: seconds, else timestamp_ntz.
    """
    def literal(moment: datetime) -> Column:
        if epoch:
            utc = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
            return F.lit(utc.timestamp())
        return F.expr(f"TIMESTAMP_NTZ '{moment.replace(tzinfo=None).isoformat(sep=' ')}'")

    start = window_start(as_of, window)
    ended = column <= literal(as_of)
    return ended if start is None else (column >= literal(start)) & ended


def age_days(created_seconds: Column, as_of: datetime) -> Column:
    """Whole days between an account's creation and `as_of`."""
    utc = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    return F.floor((F.lit(utc.timestamp()) - created_seconds) / 86400)
