"""Web-Mercator and viewport expressions, all in doubles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import constants as C


@dataclass(frozen=True)
class Viewport:
    """Visible map area; ``west > east`` means it crosses the 180° meridian."""

    north: float
    south: float
    east: float
    west: float
    zoom: int = 12

    @property
    def wraps(self) -> bool:
        return self.west > self.east


def in_viewport(lat: Column, lng: Column, view: Viewport) -> Column:
    inside_lat = lat.between(F.lit(float(view.south)), F.lit(float(view.north)))
    west, east = F.lit(float(view.west)), F.lit(float(view.east))
    inside_lng = ((lng >= west) | (lng <= east)) if view.wraps else lng.between(west, east)
    return inside_lat & inside_lng


def world_x(lng: Column, zoom: int) -> Column:
    return F.lit(float(C.TILE_SIZE * 2**zoom)) * (F.lit(0.5) + lng / F.lit(360.0))


def world_y(lat: Column, zoom: int) -> Column:
    clamp = F.lit(C.MAX_SIN_LAT)
    sin_lat = F.least(F.greatest(F.sin(F.radians(lat)), -clamp), clamp)
    merc = F.ln((F.lit(1.0) + sin_lat) / (F.lit(1.0) - sin_lat)) / F.lit(4.0 * math.pi)
    return F.lit(float(C.TILE_SIZE * 2**zoom)) * (F.lit(0.5) - merc)


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(value + F.lit(0.5))


def pixel_x(lng: Column, view: Viewport) -> Column:
    """Pixels east of the viewport's north-west corner."""
    west = float(view.west)
    unrolled = F.when(lng < F.lit(west), lng + F.lit(360.0)).otherwise(lng) if view.wraps else lng
    return round_half_up(world_x(unrolled, view.zoom) - world_x(F.lit(west), view.zoom))


def pixel_y(lat: Column, view: Viewport) -> Column:
    """Pixels south of the viewport's north-west corner."""
    return round_half_up(world_y(lat, view.zoom) - world_y(F.lit(float(view.north)), view.zoom))


def view_size(view: Viewport) -> tuple[int, int]:
    """Width and height of a viewport in pixels, as whole numbers."""
    size = float(C.TILE_SIZE * 2**view.zoom)

    def merc(lat: float) -> float:
        sin_lat = min(max(math.sin(math.radians(lat)), -C.MAX_SIN_LAT), C.MAX_SIN_LAT)
        return math.log((1.0 + sin_lat) / (1.0 - sin_lat)) / (4.0 * math.pi)

    across = (view.east - view.west) % 360.0 if view.wraps else view.east - view.west
    return math.ceil(size * across / 360.0), math.ceil(size * (merc(view.north) - merc(view.south)))


def point_radius(
    radius: Column | None, default: float | None, zoom: int, scale_radius: bool = False
) -> Column:
    """A point's own radius where it is set and not zero, else the default, else 2."""
    fallback = F.lit(float(default or C.DEFAULT_RADIUS))
    if radius is None:
        chosen = fallback
    else:
        own = radius.cast("double")
        usable = own.isNotNull() & ~F.isnan(own) & (own != F.lit(0.0))
        chosen = F.when(usable, own).otherwise(fallback)
    return chosen * F.lit(float(2**zoom if scale_radius else 1))
