"""Day tables in versions, with a ledger that says which version of a day counts.

A version is a folder ``version=<n>/data=<day>`` that is written as a whole; an entry of the
ledger then names its days. Readers take each day from its latest version in the ledger, so
they see all of a write or nothing of it, and a write that broke off leaves no trace: the
next one uses its number again. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.schemas import PARTITION, align, stored_schema
from fleetlens.sources.paths import exists, spread

VERSION = T.StructField("version", T.LongType())
# An entry has one row per day; ``files`` names what the day was made of, where that matters.
ENTRY = T.StructType(
    [
        VERSION,
        PARTITION,
        T.StructField("run_id", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("watermark", T.TimestampType()),
        T.StructField("files", T.ArrayType(T.StringType())),
    ]
)


class DayTable:
    """One table's versions under ``<root>/<table>-days`` and their ledger beside them."""

    def __init__(self, spark: SparkSession, root: str, table: str):
        self.spark, self.schema = spark, stored_schema(table)
        self.path, self.ledger = f"{root}/{table}-days", f"{root}/{table}-ledger"

    def entries(self) -> DataFrame:
        if not exists(self.spark, self.ledger):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self.ledger).select(*ENTRY.fieldNames())

    def latest(self) -> DataFrame:
        """Each day's last entry: one row a day."""
        last = F.max(F.struct("version", "files")).alias("e")
        return self.entries().where(F.col(PARTITION.name).isNotNull()).groupBy(PARTITION.name).agg(last).select(
            PARTITION.name, "e.version", "e.files"
        )

    def last_version(self) -> int:
        return self.entries().agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]

    def committed(self, run_id: str, batch_id: int) -> bool:
        """Whether this batch of this run is through."""
        own = self.entries().where((F.col("run_id") == F.lit(run_id)) & (F.col("batch_id") == F.lit(batch_id)))
        return not own.isEmpty()

    def watermark(self, run_id: str, batch_id: int):
        """Latest time any batch of the run before this one has recorded, or None."""
        own = (F.col("run_id") == F.lit(run_id)) & (F.col("batch_id") < F.lit(batch_id))
        return self.entries().where(own).agg(F.max("watermark")).first()[0]

    def read(self) -> DataFrame:
        """Every day as of its latest version.

        Versions and days are folders: what is joined is one row a day, and older versions
        are not read.
        """
        names = self.schema.fieldNames()
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, VERSION])).parquet(self.path)
        return rows.join(self.latest().drop("files"), [VERSION.name, PARTITION.name]).select(*names)

    def write(self, rows: DataFrame, version: int) -> str:
        """Write the days of a version; nobody reads them before ``commit``."""
        path = f"{self.path}/{VERSION.name}={version}"
        out = spread(align(rows, self.schema), PARTITION.name)
        out.write.mode("overwrite").partitionBy(PARTITION.name).parquet(path)
        return path

    def commit(
        self,
        version: int,
        days: DataFrame,
        run_id: str | None = None,
        batch_id: int | None = None,
        watermark=None,
    ) -> None:
        """Record a version: ``days`` has one row a day, with ``files`` if they matter.

        The entry is one file, so it is there as a whole or not at all. A version without days
        is recorded too: its batch is through.
        """
        nothing = self.spark.range(1).select(F.lit(None).cast("date").alias(PARTITION.name))
        files = ENTRY["files"].dataType
        if "files" not in days.columns:
            days = days.withColumn("files", F.lit(None).cast(files))
        rows = days.unionByName(nothing.withColumn("files", F.lit(None).cast(files)))
        entry = rows.select(
            F.lit(version).cast("long").alias("version"),
            PARTITION.name,
            F.lit(run_id).cast("string").alias("run_id"),
            F.lit(batch_id).cast("long").alias("batch_id"),
            F.lit(watermark).cast("timestamp").alias("watermark"),
            "files",
        ).coalesce(1)
        entry.write.mode("overwrite").parquet(f"{self.ledger}/entry={version}")
