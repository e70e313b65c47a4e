"""Station files: JSON arrays of station records, all fields texts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.vehicle import parse_float
from fleetlens.schemas import STATION


def read_stations(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Read station files: pretty-printed arrays, or one record a line."""
    return spark.read.schema(STATION).option("multiLine", multi_line).json(path)


def union_stations(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Bag union of station sources, each row tagged with its source's name."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged)


def with_coordinates(stations: DataFrame) -> DataFrame:
    """Latitude and longitude as numbers; texts that hold none become null."""
    return stations.withColumns(
        {"latitude": parse_float(F.col("latitude")), "longitude": parse_float(F.col("longitude"))}
    )


def station_markers(stations: DataFrame, icon: str = C.STATION_ICON) -> DataFrame:
    """Marker rows of stations."""
    return stations.select(
        F.struct(
            parse_float(F.col("latitude")).alias("lat"), parse_float(F.col("longitude")).alias("lng")
        ).alias("position"),
        F.col("estacao").alias("title"),
        F.lit(icon).alias("icon"),
    )
