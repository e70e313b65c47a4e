"""Positions stored in the order of a space-filling key, so that a viewport reads few files.

Files and row groups keep the least and greatest latitude and longitude of their rows. Rows in
the order of arrival are all over the map, so every file may hold some of a viewport; in the order
of the key each file is a small area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.geo import Viewport, in_viewport
from fleetlens.functions.zorder import z_key
from fleetlens.schemas import PARTITION, align, stored_schema, with_partition_day

NAME = "gpsdata-places"
KEY = "place"


def write_clustered(df: DataFrame, root: str, files: int, rows_per_file: int | None = None) -> str:
    """Write positions by day and place, in about ``files`` files; the folder is replaced.

    Rows are dealt by ranges of (day, place), found by Spark's sampling, and sorted within a task; a
    place most pings come from has several ranges, as the time is part of the order.
    """
    stored = align(with_partition_day(df), stored_schema("gpsdata"))
    keyed = stored.withColumn(KEY, z_key(F.col("latitude"), F.col("longitude")))
    order = [PARTITION.name, KEY, "datahora", "codigo"]
    rows = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(KEY)
    writer = rows.write.mode("overwrite").partitionBy(PARTITION.name)
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    path = f"{root}/{NAME}"
    writer.parquet(path)
    return path


def read_clustered(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(stored_schema("gpsdata")).parquet(f"{root}/{NAME}")


def in_view(rows: DataFrame, view: Viewport) -> DataFrame:
    """Positions in a viewport; its bounds are literals that files and row groups are skipped by."""
    return rows.where(in_viewport(F.col("latitude"), F.col("longitude"), view))


def file_areas(rows: DataFrame) -> DataFrame:
    """One row per file: its number of rows and the area they lie in, as its footer has them."""
    bounds: list[Column] = [
        F.count("*").alias("rows"),
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
    ]
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(*bounds)


def files_met(rows: DataFrame, view: Viewport) -> DataFrame:
    """``files`` in all and ``met``, those whose area a viewport touches."""
    if view.wraps:
        across = (F.col("east") >= F.lit(view.west)) | (F.col("west") <= F.lit(view.east))
    else:
        across = (F.col("east") >= F.lit(view.west)) & (F.col("west") <= F.lit(view.east))
    touched = (F.col("north") >= F.lit(view.south)) & (F.col("south") <= F.lit(view.north)) & across
    return file_areas(rows).agg(F.count("*").alias("files"), F.count_if(touched).alias("met"))
