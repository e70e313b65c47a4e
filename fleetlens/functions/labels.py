"""Day and hour labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label formats, e.g. ``Mon, 2017-8-28`` and ``09:00``.
DAY_LABEL = "E, yyyy-M-d"
TIME_LABEL = "HH:mm"


def wall_clock(instant: Column, tz: str | None = None) -> Column:
    """Wall-clock time in ``tz``; without it, in the session's time zone."""
    if tz is None:
        return instant
    return F.convert_timezone(None, F.lit(tz), instant.cast("timestamp_ntz"))


def day_of(instant: Column, tz: str | None = None) -> Column:
    return F.to_date(wall_clock(instant, tz))


def hour_label(instant: Column, tz: str | None = None) -> Column:
    return F.date_format(wall_clock(instant, tz), TIME_LABEL)


def day_label(day: Column) -> Column:
    return F.date_format(day, DAY_LABEL)
