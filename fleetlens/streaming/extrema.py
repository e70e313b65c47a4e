"""Running extrema of points that keep coming in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added_points(additions: DataFrame, column: str = "points") -> DataFrame:
    """Points that come several at a time, in an array of structs, as rows."""
    return additions.select(F.inline(column))


def running_extrema(
    points: DataFrame, value: str = "count", start_max: float | None = None, start_min: float | None = None
) -> DataFrame:
    """Extrema of all points so far and of the starting values, if given.

    A global aggregate: each task reduces its points to one row before the
    shuffle. Run it in complete or update mode.
    """
    v = F.col(value).cast("double")
    return points.agg(
        F.greatest(F.max(v), F.lit(start_max).cast("double")).alias("max"),
        F.least(F.min(v), F.lit(start_min).cast("double")).alias("min"),
    )
