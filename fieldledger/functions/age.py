"""Age of a stored version relative to an explicit point in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def created_seconds(committed_at: Column) -> Column:
    """Unix seconds, fraction dropped."""
    return F.unix_seconds(committed_at.cast("timestamp"))


def age_days(committed_at: Column, as_of: Column) -> Column:
    """Whole days between the two times, truncated toward zero."""
    seconds = created_seconds(as_of) - created_seconds(committed_at)
    return F.call_function("div", seconds, F.lit(SECONDS_PER_DAY))


def age(committed_at: Column, as_of: Column, format: str) -> Column:
    """`days` for the age, `timestamp` for the creation time."""
    if format in ("days", "Days"):
        return age_days(committed_at, as_of)
    if format in ("timestamp", "Timestamp"):
        return created_seconds(committed_at)
    raise ValueError(f"format must be days or timestamp, not {format!r}")
