"""Line groups, icons and itineraries as dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C


def literal_rows(spark: SparkSession, names: tuple[str, str], rows: list[tuple[str, str]]) -> DataFrame:
    """A few constant rows as a plan of literals."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def line_groups(spark: SparkSession) -> DataFrame:
    """(grupo, linha) pairs; a line may be in several groups."""
    pairs = [(group, line) for group, lines in C.LINE_GROUPS.items() for line in lines]
    return literal_rows(spark, ("grupo", "linha"), pairs)


def corridor_icons(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, ("corredor", "icon"), list(C.CORRIDOR_ICONS.items()))


def in_all_lines(positions: DataFrame) -> DataFrame:
    """Positions whose line is in the flat list."""
    return positions.filter(F.col("linha").isin(sorted(set(C.ALL_LINES))))


def in_groups(positions: DataFrame, *groups: str) -> DataFrame:
    """Positions whose line is in one of the groups, each position once.

    The dimension is a literal of a few dozen rows, so it may be broadcast.
    """
    wanted = line_groups(positions.sparkSession).filter(F.col("grupo").isin(list(groups)))
    return positions.join(F.broadcast(wanted), "linha", "left_semi")


def tag_groups(positions: DataFrame) -> DataFrame:
    """One row per position and group its line is in."""
    return positions.join(F.broadcast(line_groups(positions.sparkSession)), "linha", "inner")


def with_icon(positions: DataFrame) -> DataFrame:
    """The corridor's icon by look-up, null when there is none."""
    return positions.join(F.broadcast(corridor_icons(positions.sparkSession)), "corredor", "left")


def itinerary_stations(itinerary: DataFrame, stations: DataFrame) -> DataFrame:
    """Each stop of an itinerary with its station's coordinates.

    Neither side has a known bound: Spark broadcasts the stations if they are
    small and otherwise joins by name, splitting a station most stops share.
    """
    places = stations.select("estacao", "latitude", "longitude")
    return itinerary.join(places, "estacao", "left").select(
        "linha", "sentido", "trajeto", "destino", "sequencia", "estacao", "latitude", "longitude"
    )
