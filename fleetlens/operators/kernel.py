"""Heat by kernel: a point warms the cells its radius reaches, less the farther they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.geo import Viewport, view_size
from fleetlens.functions.vehicle import total
from fleetlens.operators.heatmap import viewport_pixels

# Parts of one that a contribution is cut to where sums are to be exact.
PARTS = 1_000_000


def reached(centre: Column, radius: Column, cell: int, size: int) -> Column:
    """Cells of an axis, within ``size`` pixels, that a radius around a pixel touches."""
    first = F.greatest(F.floor((centre - radius) / F.lit(float(cell))), F.lit(0))
    last = F.least(F.floor((centre + radius) / F.lit(float(cell))), F.lit((size - 1) // cell))
    return F.when(first <= last, F.sequence(first, last))


def kernel_heat(
    points: DataFrame,
    view: Viewport,
    value: str = "count",
    radius_field: str | None = None,
    default_radius: float | None = C.HEAT_RADIUS,
    scale_radius: bool = False,
    cell_pixels: int = 4,
    exact_scale: int | None = None,
) -> DataFrame:
    """``cell_x``, ``cell_y``, ``intensity`` and ``points`` of the viewport's cells.

    The weight of a cell falls from one at the point to zero at its radius, with the square of the
    distance of the cell's middle. Points of one pixel and radius are added up first, so what is
    spread depends on the size of the map and not on the number of points.
    """
    width, height = view_size(view)
    pixels = viewport_pixels(points, view, value, radius_field, default_radius, scale_radius)
    spots = pixels.groupBy("x", "y", "radius").agg(
        total(F.col(value), exact_scale).alias("v"), F.count("*").alias("n")
    )
    radius = F.col("radius")
    rows = spots.where(radius > 0).select(
        "*", F.explode(reached(F.col("y"), radius, cell_pixels, height)).alias("cell_y")
    )
    rows = rows.select("*", F.explode(reached(F.col("x"), radius, cell_pixels, width)).alias("cell_x"))
    dx = (F.col("cell_x") + F.lit(0.5)) * F.lit(float(cell_pixels)) - F.col("x")
    dy = (F.col("cell_y") + F.lit(0.5)) * F.lit(float(cell_pixels)) - F.col("y")
    near = rows.withColumn("share", (dx * dx + dy * dy) / (radius * radius)).where(F.col("share") < 1)
    part = F.col("v") * (F.lit(1.0) - F.col("share"))
    heat = F.sum(part) if exact_scale is None else F.sum(F.floor(part * F.lit(float(PARTS)))) / F.lit(float(PARTS))
    return near.groupBy("cell_x", "cell_y").agg(heat.alias("intensity"), F.sum("n").alias("points"))
