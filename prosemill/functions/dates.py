"""Points in time in the forms that records carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(at: Column) -> Column:
    return F.unix_millis(at)


def iso_utc(at: Column) -> Column:
    """2024-01-31T23:59:59.123Z, in UTC whatever the session's zone."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def compact_stamp(at: Column) -> Column:
    """20240131T235959Z, as file names have it."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
