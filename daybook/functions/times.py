"""Zone-free arithmetic on ``timestamp_ntz`` and calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


EPOCH_DAY = "1970-01-01"


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01, rounded down, whatever the session time zone."""
    # For times without a zone this is a plain division, but it rounds earlier
    # times towards 1970; those are put together from their fields.
    modern = F.unix_timestamp(ts)
    days = F.datediff(ts, F.lit(EPOCH_DAY).cast("date")).cast("bigint")
    earlier = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.when(ts >= F.lit(EPOCH_DAY).cast("timestamp_ntz"), modern).otherwise(earlier)


def second_diff(start: Column, end: Column) -> Column:
    """Second boundaries crossed between two timestamps (0.9 s → 2.1 s is 2)."""
    return epoch_seconds(end) - epoch_seconds(start)


def time_slot(ts: Column, seconds: int) -> Column:
    """Number of the fixed-width slot a timestamp lies in."""
    return F.floor(epoch_seconds(ts) / F.lit(seconds))
