"""Heat of all zoom levels at once: the finest is counted, the coarser ones are rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.geo import world_x, world_y
from fleetlens.functions.vehicle import summand
from fleetlens.functions.zorder import gather_bits, interleaved


def tile(world: Column, zoom: int) -> Column:
    """Tile of a world coordinate; the last one takes the edge of the map."""
    inside = F.floor(world / F.lit(float(C.TILE_SIZE)))
    return F.least(F.greatest(inside, F.lit(0)), F.lit(2**zoom - 1))


def tile_key(lat: Column, lng: Column, zoom: int) -> Column:
    """Key of the map tile a place lies in; two bits a level, the coarsest first."""
    return interleaved(tile(world_x(lng, zoom), zoom), tile(world_y(lat, zoom), zoom))


def quadkey(key: Column, zoom: Column) -> Column:
    """The usual name of a tile: one digit from 0 to 3 a level."""
    return F.lpad(F.conv(key.cast("string"), 10, 4), zoom, "0")


def heat_pyramid(
    points: DataFrame, finest: int, coarsest: int = 0, value: str = "count", exact_scale: int | None = None
) -> DataFrame:
    """``zoom``, ``quadkey``, ``tile_x``, ``tile_y``, ``intensity`` and ``points`` of every level's tiles.

    Points are read once and become one row per tile of the finest level. Only these rows are repeated per level,
    and each level's partial sums are made before its shuffle. Points without coordinates have no tile.
    """
    located = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    key = tile_key(F.col("lat"), F.col("lng"), finest).alias("key")
    cells = located.groupBy(key).agg(F.sum(summand(F.col(value), exact_scale)).alias("v"), F.count("*").alias("n"))
    levels = cells.select("*", F.explode(F.sequence(F.lit(coarsest), F.lit(finest))).alias("zoom"))
    parent = F.expr(f"shiftright(key, 2 * ({finest} - zoom))").alias("key")
    rolled = levels.groupBy("zoom", parent).agg(F.sum("v").cast("double").alias("intensity"), F.sum("n").alias("points"))
    return rolled.select(
        "zoom",
        quadkey(F.col("key"), F.col("zoom")).alias("quadkey"),
        gather_bits(F.col("key")).alias("tile_x"),
        gather_bits(F.shiftright("key", 1)).alias("tile_y"),
        "intensity",
        "points",
    )
