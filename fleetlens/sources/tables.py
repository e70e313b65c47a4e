"""Path-based tables and their writers.

Layout: ``<root>/<table>/run_id=<run>/batch_id=<n>/data=<day>/*.parquet``. One
(run, batch) folder is written as a whole, so writing a batch again replaces it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fleetlens.schemas import PARTITION, TABLES, align, stored_schema, with_partition_day
from fleetlens.sources.paths import exists, spread


def route(df: DataFrame) -> str:
    """Table a result belongs to, told by its columns."""
    if "vel_media" in df.columns:
        return "stats_vel"
    if "qtd_carros" in df.columns:
        return "stats_qtd"
    if "carros" in df.columns:
        return "stats_sketch"
    return "gpsdata"


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    columns: tuple[str, ...] = (),
    metadata: Mapping[str, str] | None = None,
    streamed: bool = True,
) -> DataFrame:
    """A table's own columns, its day, and any layout ``columns`` asked for.

    Filters on ``data`` prune folders; ``stats_*`` have it as a column anyway. ``metadata`` adds
    fields of Spark's file metadata under names of the caller's. ``streamed=False`` leaves out what
    Spark's file sink wrote.
    """
    schema = stored_schema(table)
    read = spark.read.schema(schema)
    of_file = [F.col(f"_metadata.{field}").alias(name) for name, field in (metadata or {}).items()]
    wanted = [*schema.fieldNames(), *columns, *of_file]
    sink = sink_path(root, table)
    if not streamed or not exists(spark, sink):
        return read.parquet(f"{root}/{table}").select(*wanted)
    sunk = read.parquet(sink)
    sunk = sunk.select(*schema.fieldNames(), *[F.lit(None).cast("string").alias(c) for c in columns], *of_file)
    if not exists(spark, f"{root}/{table}"):
        return sunk
    return read.parquet(f"{root}/{table}").select(*wanted).unionByName(sunk)


def sink_path(root: str, table: str) -> str:
    """Where Spark's file sink writes a table.

    Readers of such a folder see only the files in the sink's own log, so other
    writers must not share it.
    """
    return f"{root}/{table}-stream"


def write_batch(
    df: DataFrame, root: str, table: str | None = None, run_id: str | None = None, batch_id: int = 0
) -> str:
    """Write one batch of rows, replacing what the same batch wrote before."""
    table = table or route(df)
    rows = spread(align(with_partition_day(df), stored_schema(table)), PARTITION.name)
    run = run_id or uuid.uuid4().hex
    path = f"{root}/{table}/run_id={run}/batch_id={batch_id}"
    rows.write.mode("overwrite").partitionBy(PARTITION.name).parquet(path)
    return path


def append(df: DataFrame, root: str, table: str | None = None) -> str:
    """Append rows to a table, columns matched by name."""
    return write_batch(df, root, table)


def batch_writer(root: str, run_id: str, table: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that survives replays.

    ``run_id`` must be as old as the query's checkpoint: a replayed batch then
    replaces its own folder, while a query started afresh gets its own.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        write_batch(df, root, table, run_id, batch_id)

    return write


def append_jdbc(df: DataFrame, url: str, properties: dict[str, str], table: str | None = None) -> None:
    """Append rows to a database table over JDBC, set-wise, one connection a partition.

    Credentials belong in ``properties``, taken from the job's own configuration.
    """
    table = table or route(df)
    own = align(df, TABLES[table])
    own.write.jdbc(url, table, mode="append", properties=properties)


def jdbc_writer(url: str, properties: dict[str, str], table: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over JDBC; a replayed batch is appended again, unlike by ``sources.database``."""

    def write(df: DataFrame, batch_id: int) -> None:
        append_jdbc(df, url, properties, table)

    return write


def preview(df: DataFrame, rows: int = 200) -> None:
    """Print schema and first rows."""
    df.printSchema()
    df.show(rows, truncate=False)


def preview_stream(df: DataFrame, rows: int = 200, mode: str = "update") -> StreamingQuery:
    """Start printing every micro-batch of a stream."""
    writer = df.writeStream.outputMode(mode).format("console")
    return writer.option("numRows", rows).option("truncate", False).start()


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row in column ``json``, null fields written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
