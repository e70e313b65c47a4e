"""Chart queries over the statistics logs.

The logs hold one row per window, corridor and update. A chart cell is the
largest value of its label and corridor (``reduce="max"``), which for a mean may
be an interim one; ``reduce="final"`` first takes each window's last update.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.labels import day_label
from fleetlens.operators.recent import as_moment


HOUR, DAY = "hora", "data"


def chart_rows(
    stats: DataFrame,
    measure: str,
    anchor: str | date | datetime,
    days: int,
    until: date | None = None,
    reduce: str = "max",
) -> DataFrame:
    """Log rows of the days after ``anchor`` minus ``days``; the boundary day is left out.

    The bound is a date literal on the partition column, so older days are not
    read. ``reduce="final"`` keeps each window's last update only.
    """
    if reduce not in ("max", "final"):
        raise ValueError(f"reduce must be 'max' or 'final', not {reduce!r}")
    bound = as_moment(anchor) - timedelta(days=days)
    kept = stats.filter(F.col(DAY) > F.lit(bound.date()))
    if until is not None:
        kept = kept.filter(F.col(DAY) <= F.lit(until))
    return kept if reduce == "max" else last_update(kept, measure)


def last_update(stats: DataFrame, measure: str) -> DataFrame:
    """Each window's value as of its last update; of equally late ones the larger."""
    last = F.max(F.struct("atualizacao", measure)).getField(measure)
    return stats.groupBy(DAY, HOUR, "corredor").agg(last.alias(measure))


def peaks(rows: DataFrame, measure: str, axis: str) -> DataFrame:
    """Largest value per axis value and corridor."""
    cells = rows.groupBy(axis, "corredor").agg(F.max(measure).alias(measure))
    return cells.withColumn("label", day_label(F.col(DAY))) if axis == DAY else cells


def speed_by_hour(
    stats_vel: DataFrame, anchor: str | date | datetime, until: date | None = None, reduce: str = "max"
) -> DataFrame:
    """Peak mean speed per hour label; the days in range are not told apart."""
    rows = chart_rows(stats_vel, "vel_media", anchor, C.HOUR_VIEW_DAYS, until, reduce)
    return peaks(rows, "vel_media", HOUR)


def speed_by_day(
    stats_vel: DataFrame,
    anchor: str | date | datetime,
    days: int = C.SPEED_VIEW_DAYS,
    until: date | None = None,
    reduce: str = "max",
) -> DataFrame:
    """Peak hourly mean speed per day."""
    return peaks(chart_rows(stats_vel, "vel_media", anchor, days, until, reduce), "vel_media", DAY)


def vehicles_by_hour(
    stats_qtd: DataFrame, anchor: str | date | datetime, until: date | None = None, reduce: str = "max"
) -> DataFrame:
    """Peak vehicle count per hour label; the days in range are not told apart."""
    rows = chart_rows(stats_qtd, "qtd_carros", anchor, C.HOUR_VIEW_DAYS, until, reduce)
    return peaks(rows, "qtd_carros", HOUR)


def vehicles_by_day(
    stats_qtd: DataFrame,
    anchor: str | date | datetime,
    days: int = C.VEHICLE_VIEW_DAYS,
    until: date | None = None,
    reduce: str = "max",
) -> DataFrame:
    """Peak hourly vehicle count per day."""
    return peaks(chart_rows(stats_qtd, "qtd_carros", anchor, days, until, reduce), "qtd_carros", DAY)


def series(rows: DataFrame, measure: str, axis: str, corridors: Sequence[str] = C.CORRIDORS) -> DataFrame:
    """One row per axis value, one column per corridor, null where a corridor has none.

    The pivot is an aggregate of its own, so log rows need no grouping before.
    Axis values come from all rows, those of no named corridor included.
    """
    wide = rows.groupBy(axis).agg(
        *[F.max(F.when(F.col("corredor") == F.lit(c), F.col(measure))).alias(c) for c in corridors]
    )
    return wide.withColumn("label", day_label(F.col(DAY))) if axis == DAY else wide


def categories(rows: DataFrame, axis: str) -> DataFrame:
    """Distinct labels in order: days by date, not by label."""
    label = day_label(F.col(DAY)) if axis == DAY else F.col(HOUR)
    return rows.select(axis).distinct().orderBy(axis).select(label.alias("category"))


def chart_payload(
    rows: DataFrame, measure: str, axis: str, stack: str | None = None, corridors: Sequence[str] = C.CORRIDORS
) -> DataFrame:
    """The chart as one row: ``content`` (name, [stack,] data) and ``categories``.

    What is gathered is one entry per label: hours of a day, or days in range.
    """
    label = day_label(F.col(DAY)) if axis == DAY else F.col(HOUR)
    entry = F.struct(
        F.col(axis).alias("o"), label.alias("label"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(corridors)]
    )
    gathered = series(rows, measure, axis, corridors).agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    tag = [] if stack is None else [F.lit(stack).alias("stack")]
    content = F.array(
        *[
            F.struct(F.lit(c).alias("name"), *tag, F.col(f"rows.s{i}").alias("data"))
            for i, c in enumerate(corridors)
        ]
    )
    return gathered.select(content.alias("content"), F.col("rows.label").alias("categories"))


def speed_chart(
    stats_vel: DataFrame,
    anchor: str | date | datetime,
    per_day: bool = True,
    until: date | None = None,
    reduce: str = "max",
) -> DataFrame:
    """Chart of mean speed: by hour (``per_day``), or by day over the last seven."""
    days, axis = (C.HOUR_VIEW_DAYS, HOUR) if per_day else (C.SPEED_VIEW_DAYS, DAY)
    return chart_payload(chart_rows(stats_vel, "vel_media", anchor, days, until, reduce), "vel_media", axis)


def vehicle_chart(
    stats_qtd: DataFrame,
    anchor: str | date | datetime,
    per_day: bool = True,
    until: date | None = None,
    reduce: str = "max",
) -> DataFrame:
    """Chart of vehicle counts: by hour (``per_day``), or by day over the last six."""
    days, axis = (C.HOUR_VIEW_DAYS, HOUR) if per_day else (C.VEHICLE_VIEW_DAYS, DAY)
    rows = chart_rows(stats_qtd, "qtd_carros", anchor, days, until, reduce)
    return chart_payload(rows, "qtd_carros", axis, stack=C.VEHICLE_STACK)
