"""Windowed statistics of positions; the same code serves batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.labels import day_of, hour_label
from fleetlens.functions.vehicle import mean

STAT_COLUMNS = ("data", "hora", "atualizacao")
BY_CORRIDOR = ("corredor",)
LEVELS = ("corredor", "linha", "sentido")
# The measure that is a sketch of vehicles, see ``operators.sketches``.
SKETCH = "carros"


def vehicle_count(approx: bool = False, rsd: float | None = None) -> Column:
    """Distinct vehicles, exact or by sketch with relative error ``rsd``."""
    if approx:
        return F.approx_count_distinct("codigo", rsd)
    return F.count_distinct("codigo")


def grouped(
    positions: DataFrame, window: str, by: Sequence[str], measures: dict[str, Column]
) -> DataFrame:
    """Measures per tumbling window and ``by`` columns, the window kept as a struct."""
    return positions.groupBy(F.window("datahora", window), *by).agg(
        *[expr.alias(name) for name, expr in measures.items()]
    )


def labelled(groups: DataFrame, measure: str, by: Sequence[str], positive_only: bool, tz: str | None) -> DataFrame:
    """One measure of windowed groups with day, hour label and update time."""
    start = F.col("window.start")
    size = F.hll_sketch_estimate(measure) if measure == SKETCH else F.col(measure)
    kept = groups.filter(size > 0) if positive_only else groups
    return kept.select(
        *by,
        measure,
        day_of(start, tz).alias("data"),
        hour_label(start, tz).alias("hora"),
        F.current_timestamp().alias("atualizacao"),
    )


def window_speed(
    positions: DataFrame,
    window: str = C.BATCH_WINDOW,
    by: Sequence[str] = BY_CORRIDOR,
    positive_only: bool = False,
    exact_scale: int | None = None,
    tz: str | None = None,
) -> DataFrame:
    """Mean speed; ``positive_only`` drops groups whose mean is zero or absent."""
    groups = grouped(positions, window, by, {"vel_media": mean(F.col("velocidade"), exact_scale)})
    return labelled(groups, "vel_media", by, positive_only, tz)


def window_vehicles(
    positions: DataFrame,
    window: str = C.BATCH_WINDOW,
    by: Sequence[str] = BY_CORRIDOR,
    positive_only: bool = False,
    approx: bool = False,
    rsd: float | None = None,
    tz: str | None = None,
) -> DataFrame:
    """Distinct vehicles, exact by default."""
    groups = grouped(positions, window, by, {"qtd_carros": vehicle_count(approx, rsd)})
    return labelled(groups, "qtd_carros", by, positive_only, tz)


def batch_stats(positions: DataFrame, window: str = C.BATCH_WINDOW) -> tuple[DataFrame, DataFrame]:
    """Mean speed and exact vehicle count of one bounded set of positions."""
    return window_speed(positions, window), window_vehicles(positions, window)


def combined_stats(
    positions: DataFrame,
    window: str = C.STREAM_WINDOW,
    approx: bool = False,
    rsd: float | None = None,
    exact_scale: int | None = None,
) -> DataFrame:
    """Both measures per window, corridor, line and direction."""
    groups = grouped(
        positions,
        window,
        LEVELS,
        {"vel_media": mean(F.col("velocidade"), exact_scale), "qtd_carros": vehicle_count(approx, rsd)},
    )
    return groups.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *LEVELS,
        "vel_media",
        "qtd_carros",
        F.current_timestamp().alias("datahora"),
    )


def stats_rollup(
    positions: DataFrame, window: str = C.STREAM_WINDOW, exact_scale: int | None = None
) -> DataFrame:
    """Both measures at every level from line and direction up to the window.

    ``level`` tells how many of corridor, line and direction a row keeps.

    Counting distinct vehicles per level in the grouping sets would shuffle every
    vehicle once per level. Instead the rows are brought down to one per vehicle
    and finest group, and of a vehicle's rows in a window, in order, the first
    of each level is marked. The levels then only add numbers up.
    """
    speed = F.col("velocidade")
    summand = speed if exact_scale is None else speed.cast(f"decimal(18,{exact_scale})")
    per_vehicle = positions.groupBy(F.window("datahora", window), *LEVELS, "codigo").agg(
        F.sum(summand).alias("speed_sum"), F.count(speed).alias("speed_n")
    )
    keys = ["window_start", *LEVELS]
    slim = per_vehicle.select(
        F.col("window.start").alias("window_start"), *LEVELS, "codigo", "speed_sum", "speed_n"
    )
    in_order = Window.partitionBy("window_start", "codigo").orderBy(*LEVELS)

    def starts(depth: int) -> Column:
        """True on the first of a vehicle's rows with the same first ``depth`` levels."""
        if depth == 0:
            return F.row_number().over(in_order) == 1
        if depth == len(LEVELS):
            return F.lit(True)
        group = F.struct(*LEVELS[:depth])
        return ~group.eqNullSafe(F.lag(group).over(in_order))

    counts = {f"vehicles_{depth}": starts(depth) for depth in range(len(LEVELS) + 1)}
    known = F.col("codigo").isNotNull()
    marked = slim.select(
        *keys, "speed_sum", "speed_n", *[(known & first).cast("int").alias(n) for n, first in counts.items()]
    )
    rolled = marked.groupingSets([keys[:n] for n in range(len(keys), 0, -1)], *keys).agg(
        (F.lit(len(LEVELS)) - F.expr("bit_count(grouping_id())")).alias("level"),
        F.try_divide(F.sum("speed_sum").cast("double"), F.sum("speed_n")).alias("vel_media"),
        *[F.sum(n).alias(n) for n in counts],
    )
    count = F.element_at(F.array(*counts), F.col("level") + 1)
    return rolled.select(*keys, "level", "vel_media", count.alias("qtd_carros"))


def corridor_counts(positions: DataFrame) -> DataFrame:
    """Pings per corridor."""
    return positions.groupBy("corredor").agg(F.count("*").alias("pings"))
