"""Snapshot files: JSON documents with one array of vehicle records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.schemas import SNAPSHOT

# Fixed value: landed files carry their time as ``..._yyyyMMddHHmmss.json``.
SNAPSHOT_NAME = r"_(\d{14})\.json"


def read_snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Batch read of snapshot files."""
    return spark.read.schema(SNAPSHOT).json(path)


def stream_snapshots(
    spark: SparkSession,
    files_dir: str,
    max_files: int | None = C.MAX_FILES_PER_TRIGGER,
    max_bytes: int | None = None,
) -> DataFrame:
    """Streaming read of a directory snapshots land in.

    ``max_bytes`` limits a micro-batch by size instead of by
    number of files; Spark allows one of the two.
    """
    reader = spark.readStream.schema(SNAPSHOT)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(files_dir)


def snapshot_time(path: Column, pattern: str = SNAPSHOT_NAME) -> Column:
    """Snapshot time from a file path, null when the path has none."""
    stamp = F.regexp_extract(path, pattern, 1)
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))


def with_snapshot_time(snapshots: DataFrame, pattern: str = SNAPSHOT_NAME) -> DataFrame:
    """Add ``snapshot_ts``; call it on the DataFrame a reader returned."""
    return snapshots.select("*", snapshot_time(F.col("_metadata.file_path"), pattern).alias("snapshot_ts"))
