"""What the writers of path tables share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import shuffle_width


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove one file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, False)


def spread(rows: DataFrame, column: str) -> DataFrame:
    """Rows spread by a folder column and their source task, for a partitioned write.

    AQE's rebalance cuts what is too large for one task and joins what is small.
    The source task is part of it as sizes are compressed ones: copies of one
    row weigh next to nothing, however many a folder gets. There are as many parts as a
    shuffle has partitions; AQE joins small ones. Without AQE (as in a
    stateful micro-batch) nothing would cut a large folder, so rows are left where
    they are.
    """
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        return rows
    part = F.pmod(F.spark_partition_id(), F.lit(shuffle_width(rows.sparkSession))).alias("part")
    return rows.select("*", part).hint("rebalance", column, "part").drop("part")
