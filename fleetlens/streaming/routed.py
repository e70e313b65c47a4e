"""Positions without loss: late pings go to a table of their own, those of open hours are kept.

Spark's streaming dedupe drops a ping older than the watermark even if its hour is still open,
without a trace. Here the event-time state is the tables themselves. A micro-batch is routed by
the watermark of the batches before it, which a ledger keeps:

* pings whose window has closed go to ``gpsdata_late``;
* of the others those already in ``gpsdata`` are left out (only hours that are open are read);
* the rest is appended, and the statistics of the windows it touches are computed again from the
  table and replace the old ones (``sources.upsert``).

What a batch writes follows from the batches before it, so a replayed one writes the same again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fleetlens.operators.positions import KEY, clean_snapshots, dedupe
from fleetlens.operators.stats import BY_CORRIDOR, grouped, labelled
from fleetlens.schemas import PARTITION, partition_day, with_partition_day
from fleetlens.sources.paths import exists
from fleetlens.sources.snapshots import stream_snapshots
from fleetlens.sources.tables import read_table, write_batch
from fleetlens.sources.upsert import upsert_batch
from fleetlens.sources.versions import DayTable
from fleetlens.streaming import ingest

LATE = "gpsdata_late"


def window_start(spark: SparkSession, moment: datetime, window: str) -> datetime:
    """Start of the window a time lies in; windows that end later are open at that time."""
    return spark.range(1).select(F.window(F.lit(moment), window)["start"]).first()[0]


def since(rows: DataFrame, moment: datetime) -> DataFrame:
    """Rows from a time on; the bound on the day prunes folders, the one on the time row groups."""
    bound = F.lit(moment).cast("timestamp")
    day = partition_day(bound, rows.schema["datahora"].dataType)
    return rows.where((F.col("datahora") >= bound) & (F.col(PARTITION.name) >= day))


def earlier(spark: SparkSession, root: str, first: datetime, run: str, batch_id: int) -> DataFrame | None:
    """Keys of the table's pings from ``first`` on that this batch or a later one has not written."""
    if not exists(spark, f"{root}/gpsdata"):
        return None
    rows = since(read_table(spark, root, "gpsdata", ("run_id", "batch_id"), streamed=False), first)
    own = (F.col("run_id") == F.lit(run)) & (F.col("batch_id").cast("long") >= F.lit(batch_id))
    return rows.where(~own).select(*KEY)


def route_batch(rows: DataFrame, config: ingest.IngestConfig, run: str, batch_id: int) -> None:
    """Write one micro-batch of clean positions."""
    spark, root = rows.sparkSession, config.out_dir
    ledger = DayTable(spark, root, "gpsdata")
    watermark = ledger.watermark(run, batch_id)
    rows.persist()
    try:
        first, last = rows.agg(F.min("datahora"), F.max(F.col("datahora") - F.expr(f"INTERVAL {config.delay}"))).first()
        none = spark.range(0).select(F.lit(None).cast("date").alias(PARTITION.name))
        if first is None:
            ledger.commit(ledger.last_version() + 1, none, run, batch_id, watermark)
            return
        kept = rows
        if watermark is not None:
            opened = window_start(spark, watermark, config.window)
            bound = F.lit(opened).cast("timestamp")
            write_batch(rows.where(F.col("datahora") < bound), root, LATE, run, batch_id)
            kept, first = rows.where(F.col("datahora") >= bound), max(first, opened)
        kept = dedupe(kept)
        seen = earlier(spark, root, first, run, batch_id)
        kept = kept if seen is None else kept.join(seen, list(KEY), "left_anti")
        path = write_batch(kept, root, "gpsdata", run, batch_id)
        restate(spark, config, path, first, run, batch_id)
        ledger.commit(ledger.last_version() + 1, none, run, batch_id, last)
    finally:
        rows.unpersist()


def restate(spark: SparkSession, config: ingest.IngestConfig, path: str, first: datetime, run: str, batch_id: int) -> None:
    """Statistics of the windows that the batch written to ``path`` touches, from the whole table."""
    window = F.window("datahora", config.window).alias("window")
    touched = spark.read.schema("datahora timestamp").parquet(path).select(window).distinct()
    rows = since(read_table(spark, config.out_dir, "gpsdata", streamed=False), window_start(spark, first, config.window))
    rows = rows.select("*", window).join(touched, "window", "left_semi").drop("window")
    measures = ingest.measures_of(config)
    groups = grouped(rows, config.window, BY_CORRIDOR, {m: ingest.measure(config, m) for m in measures}).persist()
    try:
        for name in measures:
            upsert_batch(labelled(groups, name, BY_CORRIDOR, True, config.tz), config.out_dir, run, batch_id)
    finally:
        groups.unpersist()


def start_routed(spark: SparkSession, config: ingest.IngestConfig) -> StreamingQuery:
    """The one query of the ``routed`` layout."""
    snapshots = stream_snapshots(spark, config.files_dir, config.max_files, config.max_bytes)

    def write(rows: DataFrame, batch_id: int) -> None:
        route_batch(rows, config, ingest.query_run(rows), batch_id)

    positions = ingest.for_files(clean_snapshots(snapshots), config)
    return ingest.begin(config, positions, "positions", "append", lambda w: w.foreachBatch(write).start())


def counts(spark: SparkSession, config: ingest.IngestConfig) -> DataFrame:
    """Pings kept and late, per corridor."""
    found = [("kept", "gpsdata"), ("late", LATE)]
    rows = [
        read_table(spark, config.out_dir, table, streamed=False).select("corredor", F.lit(name).alias("fate"))
        for name, table in found
        if exists(spark, f"{config.out_dir}/{table}")
    ]
    if not rows:
        return spark.createDataFrame([], "corredor string, kept long, late long")
    whole = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return whole.groupBy("corredor").agg(*[F.count_if(F.col("fate") == F.lit(name)).alias(name) for name, _ in found])
