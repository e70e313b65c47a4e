"""Nearest place of each position, by grid cells and widening rings, and the stop that follows it.

Places lie in cells of a grid. A position looks at its own cell and the ring around it; whatever
lies beyond is farther than one cell, so a place found within that distance is the nearest. What has
found none looks at cells four times as wide, and so on until a cell is wider than the map.
No position meets all places, unless there are none near.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.session import scratch_dir

# Degrees of the first cells, how much wider those of the next round are, and what no map exceeds.
CELL, WIDER, WORLD = 0.02, 4, 1024.0
AXES = ("latitude", "longitude")


def squared_distance(lat: Column, lng: Column, other_lat: Column, other_lng: Column, squeeze: float) -> Column:
    """Square of the distance in degrees of latitude on a map that is flat around one latitude."""
    dy, dx = lat - other_lat, lng - other_lng
    return dy * dy + dx * dx * F.lit(squeeze)


def squeeze_at(latitude: float) -> float:
    """Square of what a degree of longitude is there, in degrees of latitude."""
    return math.cos(math.radians(latitude)) ** 2


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: a round's work is not done again by the next."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def nearest_places(
    positions: DataFrame,
    places: DataFrame,
    name: str,
    keys: Sequence[str] = (),
    latitude: float = 0.0,
    cell: float = CELL,
) -> DataFrame:
    """``keys``, coordinates, ``name`` and ``distance2`` of the nearest place of each distinct position.

    Only places of equal ``keys`` count. Of equally near ones the smallest ``name`` is taken.
    ``latitude`` is that of the middle of the map. Rows without coordinates, and positions whose keys
    have no place, are not in the result.
    """
    squeeze = squeeze_at(latitude)
    both = F.lit(True)
    for axis in AXES:
        both = both & F.col(axis).isNotNull()
    # Pings of one spot are one position here.
    waiting = positions.select(*keys, *AXES).where(both).distinct()
    # Of places in one spot only the smallest name can be the answer.
    known = places.where(both & F.col(name).isNotNull()).groupBy(*keys, *AXES).agg(F.min(name).alias(name))
    known = known.withColumnsRenamed({axis: f"place_{axis}" for axis in AXES})
    if keys:
        waiting = waiting.join(known.select(*keys).distinct(), list(keys), "left_semi")
    elif known.isEmpty():
        waiting = waiting.limit(0)
    # Both sides are read once a round.
    waiting, known, found, size = staged(waiting, "nearest"), staged(known, "nearest"), [], cell
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    while not waiting.isEmpty():
        last = size > WORLD
        cells = known.withColumns(
            {"cx": cell_of(F.col("place_longitude"), size), "cy": cell_of(F.col("place_latitude"), size)}
        )

        def pairs(spots: DataFrame) -> DataFrame:
            around = spots.select("*", F.explode(ring).alias("o")).select(
                *spots.columns,
                (cell_of(F.col("longitude"), size) + F.col("o.x")).alias("cx"),
                (cell_of(F.col("latitude"), size) + F.col("o.y")).alias("cy"),
            )
            return around.join(cells, [*keys, "cx", "cy"])

        d2 = squared_distance(
            F.col("latitude"), F.col("longitude"), F.col("place_latitude"), F.col("place_longitude"), squeeze
        )
        # A place outside the ring is at least this far away.
        sure = size * size * min(1.0, squeeze) if not last else math.inf
        # The least number is found without sorting the pairs, names are compared for equally near places alone.
        least = pairs(waiting).groupBy(*waiting.columns).agg(F.min(d2).alias("distance2"))
        least = staged(least.where(F.col("distance2") < F.lit(sure)), "nearest")
        equal = pairs(least).where(d2 == F.col("distance2"))
        done = equal.groupBy(*waiting.columns, "distance2").agg(F.min(name).alias(name))
        done = staged(done.select(*waiting.columns, name, "distance2"), "nearest")
        found.append(done)
        if last:
            break
        waiting = staged(waiting.join(done.select(*waiting.columns), waiting.columns, "left_anti"), "nearest")
        size *= WIDER
    if not found:
        return waiting.select("*", F.lit(None).cast(known.schema[name].dataType).alias(name), F.lit(None).cast("double").alias("distance2")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_nearest(
    positions: DataFrame, places: DataFrame, name: str, keys: Sequence[str] = (), latitude: float = 0.0, cell: float = CELL
) -> DataFrame:
    """Every position with its nearest place, null where there is none."""
    near = nearest_places(positions, places, name, keys, latitude, cell)
    return positions.join(near, [*keys, *AXES], "left")


def following_stops(itinerary: DataFrame) -> DataFrame:
    """Each stop of a line and direction with the one after it, null at the end.

    A station that a line passes more than once counts with its first stop.
    """
    order = Window.partitionBy("linha", "sentido").orderBy("sequencia", "estacao")
    after = itinerary.withColumn("proxima", F.lead("estacao").over(order))
    first = F.min(F.struct("sequencia", "proxima")).alias("f")
    return after.groupBy("linha", "sentido", "estacao").agg(first).select("linha", "sentido", "estacao", "f.proxima")


def next_stops(positions: DataFrame, itinerary: DataFrame, latitude: float = 0.0, cell: float = CELL) -> DataFrame:
    """Every position with the nearest stop of its own line and direction, and the stop after that.

    ``itinerary`` has the stops' coordinates (``operators.dimensions.itinerary_stations``), lines as texts.
    """
    near = with_nearest(positions, itinerary, "estacao", ("linha", "sentido"), latitude, cell)
    return near.join(following_stops(itinerary), ["linha", "sentido", "estacao"], "left")
