"""Archive of days in few files, beside a table that a stream writes in many.

The archive is a versioned day table whose ledger names the files each day was made of. What a
reader gets is every row once, whatever was archived, how often and in which order: archived days
from the copy, and from the live table all files that no archived day names. Rows that reach a day
after its archive are such files, and the next archive of the day takes them in.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import PARTITION
from fleetlens.sources.paths import remove
from fleetlens.sources.tables import read_table
from fleetlens.sources.versions import DayTable

FILE = "file"


def named_files(archived: DataFrame) -> DataFrame:
    return archived.select(PARTITION.name, F.explode("files").alias(FILE))


def live_rows(spark: SparkSession, root: str, table: str, archived: DataFrame) -> DataFrame:
    """Rows of the live table whose file no archived day names.

    Days that were never archived are read as they are; only the files of archived days are
    looked up. The list of these days, one literal a day, prunes folders.
    """
    rows = read_table(spark, root, table, metadata={FILE: "file_name"})
    closed = [r[0] for r in archived.select(PARTITION.name).collect()]
    if not closed:
        return rows
    day = F.col(PARTITION.name)
    open_days = rows.where(~day.isin(closed) | day.isNull())
    late = rows.where(day.isin(closed)).join(named_files(archived), [PARTITION.name, FILE], "left_anti")
    return open_days.unionByName(late)


def archive(spark: SparkSession, root: str, table: str, history: str, since: date, before: date) -> list[date]:
    """Take the days from ``since`` up to ``before`` into the archive; the days that changed.

    A day that has files which are not archived yet gets a new version: what was archived of it and
    these files together. Archiving again changes nothing. The originals are left, see
    ``remove_archived``.
    """
    day = F.col(PARTITION.name)
    versions = DayTable(spark, history, table)
    archived = versions.latest()
    fresh = live_rows(spark, root, table, archived).where((day >= F.lit(since)) & (day < F.lit(before)))
    days = [r[0] for r in fresh.select(PARTITION.name).distinct().collect()]
    if not days:
        return []
    old = versions.read().where(day.isin(days))
    version = versions.last_version() + 1
    versions.write(old.unionByName(fresh.drop(FILE)), version)
    names = fresh.select(PARTITION.name, FILE).unionByName(named_files(archived.where(day.isin(days))))
    versions.commit(version, names.groupBy(PARTITION.name).agg(F.collect_set(FILE).alias("files")))
    return sorted(days)


def read_archived(spark: SparkSession, root: str, table: str, history: str) -> DataFrame:
    """Every row of the table once: archived days from the archive, the rest from where it was written."""
    versions = DayTable(spark, history, table)
    return versions.read().unionByName(live_rows(spark, root, table, versions.latest()).drop(FILE))


def remove_archived(spark: SparkSession, root: str, table: str, history: str) -> int:
    """Remove the live files that the archive holds; how many they were.

    For tables written batch by batch only: Spark's file sink keeps a log of its own files.
    """
    archived = DayTable(spark, history, table).latest()
    place = read_table(spark, root, table, metadata={FILE: "file_name", "path": "file_path"}, streamed=False)
    held = place.join(named_files(archived), [PARTITION.name, FILE], "left_semi").select("path").distinct()
    count = 0
    for row in held.toLocalIterator():
        remove(spark, row.path)
        count += 1
    return count
