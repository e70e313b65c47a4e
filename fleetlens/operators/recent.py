"""Recent positions and their marker form."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens import constants as C
from fleetlens.functions.vehicle import corridor_icon
from fleetlens.schemas import partition_day


def as_moment(anchor: str | date | datetime) -> datetime:
    """A day stands for its midnight."""
    if isinstance(anchor, str):
        return datetime.fromisoformat(anchor)
    if isinstance(anchor, datetime):
        return anchor
    return datetime(anchor.year, anchor.month, anchor.day)


def moment_literal(moment: datetime, like: T.DataType) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast(like)


def for_corridor(df: DataFrame, corridor: str | None) -> DataFrame:
    """Rows of one corridor; ``None`` and the selector's "all" option keep every row."""
    if corridor is None or corridor == C.ALL_CORRIDORS:
        return df
    return df.filter(F.col("corredor") == F.lit(corridor))


def recent_positions(
    gps: DataFrame,
    anchor: str | date | datetime,
    minutes: int = C.RECENT_MINUTES,
    corridor: str | None = None,
) -> DataFrame:
    """Every ping later than ``anchor`` minus ``minutes``.

    The bound is a literal, so the scan gets it. A table partitioned by day is
    also filtered on the bound's day, as Spark cannot infer it from ``datahora``.
    """
    since = as_moment(anchor) - timedelta(minutes=minutes)
    kind = gps.schema["datahora"].dataType
    bound = moment_literal(since, kind)
    rows = gps.filter(F.col("datahora") > bound)
    if "data" in gps.columns:
        rows = rows.filter(F.col("data") >= partition_day(bound, kind))
    return for_corridor(rows, corridor).select("latitude", "longitude", "trajeto", "velocidade", "corredor")


def markers(positions: DataFrame) -> DataFrame:
    """Positions in marker form, with the corridor's icon."""
    return positions.select(
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lng"),
        F.col("trajeto").alias("title"),
        F.col("velocidade").alias("count"),
        corridor_icon("corredor").alias("icon"),
    )
