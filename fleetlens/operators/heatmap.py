"""Heat points, viewport extrema and the heat grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.geo import Viewport, in_viewport, pixel_x, pixel_y, point_radius
from fleetlens.functions.vehicle import total


def heat_points(rows: DataFrame, lat: str = "lat", lng: str = "lng", value: str = "count") -> DataFrame:
    """Only what the heat map needs: ``lat``, ``lng``, ``count``."""
    return rows.select(F.col(lat).alias("lat"), F.col(lng).alias("lng"), F.col(value).alias("count"))


def located(
    rows: DataFrame,
    lat_field: str = "lat",
    lng_field: str = "lng",
    value_field: str = "value",
    radius_field: str | None = None,
) -> DataFrame:
    """Points with a coordinate struct, field names chosen by the caller."""
    columns = [
        F.struct(F.col(lat_field).alias("lat"), F.col(lng_field).alias("lng")).alias("latlng"),
        F.col(value_field),
    ]
    if radius_field is not None:
        columns.append(F.col(radius_field).alias("radius"))
    return rows.select(*columns)


def visible(points: DataFrame, view: Viewport) -> DataFrame:
    """Points inside the viewport; the bounds are literals the scan can use."""
    return points.filter(in_viewport(F.col("lat"), F.col("lng"), view))


def viewport_pixels(
    points: DataFrame,
    view: Viewport,
    value: str = "count",
    radius_field: str | None = None,
    default_radius: float | None = C.HEAT_RADIUS,
    scale_radius: bool = False,
) -> DataFrame:
    """Visible points as pixel offsets from the viewport's north-west corner."""
    own = F.col(radius_field) if radius_field is not None else None
    return visible(points, view).select(
        pixel_x(F.col("lng"), view).alias("x"),
        pixel_y(F.col("lat"), view).alias("y"),
        F.col(value),
        point_radius(own, default_radius, view.zoom, scale_radius).alias("radius"),
    )



def extrema(points: DataFrame, value: str = "count", zero_floor: bool = False) -> DataFrame:
    """Largest and smallest value; with ``zero_floor`` both start at zero."""
    v = F.col(value).cast("double")
    high, low = F.max(v), F.min(v)
    if zero_floor:
        zero = F.lit(0.0)
        high, low = F.greatest(high, zero), F.least(low, zero)
    return points.agg(high.alias("max"), low.alias("min"))


def viewport_extrema(
    points: DataFrame, view: Viewport, value: str = "count", zero_floor: bool = True
) -> DataFrame:
    """Extrema of the visible points."""
    return extrema(visible(points, view), value, zero_floor)


def display_extrema(
    points: DataFrame,
    view: Viewport,
    value: str = "count",
    use_local: bool = True,
    given_max: float | None = None,
    given_min: float | None = None,
) -> DataFrame:
    """The extrema a map is coloured by.

    Local: those of the viewport. Global: the given ones, and where one is not
    given, that of all points.
    """
    if use_local:
        return viewport_extrema(points, view, value)
    everywhere = extrema(points, value)
    return everywhere.select(
        F.coalesce(F.lit(given_max).cast("double"), F.col("max")).alias("max"),
        F.coalesce(F.lit(given_min).cast("double"), F.col("min")).alias("min"),
    )


def heat_grid(
    points: DataFrame,
    view: Viewport,
    value: str = "count",
    cell_pixels: int = C.HEAT_RADIUS,
    exact_scale: int | None = None,
) -> DataFrame:
    """Intensity per square cell of the viewport.

    Grouping is by cell with partial sums, so a cell most pings fall in (a depot)
    costs no more than any other.
    """
    cell = F.lit(float(cell_pixels))
    pixels = viewport_pixels(points, view, value)
    return (
        pixels.groupBy(
            F.floor(F.col("x") / cell).alias("cell_x"), F.floor(F.col("y") / cell).alias("cell_y")
        )
        .agg(total(F.col(value), exact_scale).alias("intensity"), F.count("*").alias("points"))
    )
