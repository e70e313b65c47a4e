"""Streaming ingest: snapshots to positions and hourly statistics.

Two layouts write the same tables.

``shared`` (default) parses and dedupes the snapshots once. The positions query
appends to ``gpsdata`` with Spark's own file sink, which commits each batch once;
the statistics query streams from that folder and computes both measures in one
aggregation. It takes whole commits of the first query only (no file limit), so
its watermark is never ahead of the rows it still has to read.

``independent`` starts three queries, each from the snapshots, as separate as
they can be: one may be stopped, rescaled or restarted without the others.

``routed`` is one query that loses nothing: late pings have a table of their own and
statistics are those of all that was kept (``streaming.routed``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fleetlens import constants as C
from fleetlens.functions.vehicle import mean
from fleetlens.operators.positions import clean_snapshots, dedupe_stream
from fleetlens.operators.sketches import vehicle_sketch
from fleetlens.operators.stats import BY_CORRIDOR, SKETCH, grouped, labelled, vehicle_count
from fleetlens.schemas import PARTITION, stored_schema, with_partition_day
from fleetlens.session import (
    CHANGELOG,
    ROCKSDB,
    SHUFFLE_PARTITIONS,
    STATE_PROVIDER,
    scoped_conf,
    state_partitions,
)
from fleetlens.sources.snapshots import stream_snapshots
from fleetlens.sources.database import append_once
from fleetlens.sources.tables import sink_path, write_batch
from fleetlens.sources.upsert import upsert_batch
from fleetlens.streaming.progress import ProgressTable

# Planned trigger intervals of the three independent queries.
PLANNED_TRIGGERS = {"positions": "1 minute", "speed": "1 hour", "vehicles": "1 day"}

# State on executor disks rather than in their heaps; a commit uploads its changes only.
STATE_CONF = {STATE_PROVIDER: ROCKSDB, CHANGELOG: "true"}


@dataclass(frozen=True)
class IngestConfig:
    """Parameters of the ingest job."""

    files_dir: str
    out_dir: str
    checkpoint_dir: str
    layout: str = "shared"
    # Put before query names, as a session runs one query of a name at a time.
    name_prefix: str = ""
    window: str = C.STREAM_WINDOW
    delay: str = C.WATERMARK_DELAY
    rsd: float | None = None
    # Base-2 logarithm of the size of vehicle sketches; without it none are kept.
    sketch_lg_k: int | None = None
    # One row per window and corridor, replaced by later updates, instead of the update log.
    upsert: bool = False
    exact_scale: int | None = None
    tz: str | None = None
    # Partitions of all state; must be stated on a cluster, as checkpoints keep it.
    state_partitions: int | None = None
    # Tasks a repeated ping is spread over before the last dedupe; as many as there
    # are state partitions unless stated, 1 for none.
    salt_buckets: int | None = None
    max_files: int | None = C.MAX_FILES_PER_TRIGGER
    max_bytes: int | None = None
    # Limit of the statistics' micro-batches in the shared layout. A part of a commit of
    # positions then moves the watermark, so ``stats_delay`` must cover the event times of one.
    stats_max_bytes: int | None = None
    stats_delay: str | None = None
    # Without it every state partition writes its own file per day and batch; a
    # number spreads each batch's new positions evenly over that many tasks.
    files_per_batch: int | None = None
    # ``availableNow`` processes what has landed and stops; a text such as
    # "1 minute" is a processing-time interval, a mapping has one per query name;
    # None runs batches back to back.
    trigger: str | Mapping[str, str] | None = "availableNow"
    # Database all three results go to instead of the path tables (layout
    # ``independent`` only). Credentials belong in the properties.
    jdbc_url: str | None = None
    jdbc_properties: Mapping[str, str] = field(default_factory=dict, repr=False)
    # Table of progress reports, kept if stated.
    progress_dir: str | None = None
    # Settings a query is started with where the session has none of its own.
    conf: dict[str, str] = field(default_factory=lambda: dict(STATE_CONF))


def realtime_positions(spark: SparkSession, config: IngestConfig) -> DataFrame:
    """Clean, deduplicated position stream."""
    snapshots = stream_snapshots(spark, config.files_dir, config.max_files, config.max_bytes)
    salts = config.salt_buckets or state_partitions(spark, config.state_partitions)
    return dedupe_stream(clean_snapshots(snapshots), config.delay, salts)


def for_files(rows: DataFrame, config: IngestConfig) -> DataFrame:
    return rows if config.files_per_batch is None else rows.repartition(config.files_per_batch)


def measures_of(config: IngestConfig) -> tuple[str, ...]:
    return ("vel_media", "qtd_carros", *([SKETCH] if config.sketch_lg_k else []))


def measure(config: IngestConfig, name: str):
    if name == SKETCH:
        return vehicle_sketch(config.sketch_lg_k)
    if name == "vel_media":
        return mean(F.col("velocidade"), config.exact_scale)
    return vehicle_count(approx=True, rsd=config.rsd)


def begin(config: IngestConfig, df: DataFrame, name: str, mode: str, sink: Callable) -> StreamingQuery:
    """Start a query with its own checkpoint and the configured trigger."""
    writer = df.writeStream.queryName(config.name_prefix + name).outputMode(mode)
    writer = writer.option("checkpointLocation", f"{config.checkpoint_dir}/{name}")
    trigger = config.trigger.get(name) if isinstance(config.trigger, Mapping) else config.trigger
    if trigger == "availableNow":
        writer = writer.trigger(availableNow=True)
    elif trigger is not None:
        writer = writer.trigger(processingTime=trigger)
    partitions = state_partitions(df.sparkSession, config.state_partitions)
    with scoped_conf(df.sparkSession, config.conf, {SHUFFLE_PARTITIONS: str(partitions)}):
        return sink(writer)


def query_run(df: DataFrame) -> str:
    """Id a streaming query keeps for the life of its checkpoint."""
    run = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise RuntimeError("not inside a streaming query: a replayed batch could not replace itself")
    return run


def save(rows: DataFrame, config: IngestConfig, run: str, batch_id: int) -> None:
    """One batch of a table's rows to the job's sink; a replayed batch is there once in each."""
    if config.jdbc_url is None:
        write_batch(rows, config.out_dir, run_id=run, batch_id=batch_id)
    else:
        append_once(rows, config.jdbc_url, dict(config.jdbc_properties), run, batch_id)


def stats_sink(config: IngestConfig, measures: tuple[str, ...]) -> Callable:
    """Write each measure of a micro-batch to its own log.

    With two measures the batch is kept while both are written: computing it
    again would read and commit the state a second time. It holds one row per
    changed window and corridor, not pings, so a day's rows may share a file.
    """

    def write(groups: DataFrame, batch_id: int) -> None:
        run = query_run(groups)
        shared = len(measures) > 1
        if shared:
            groups.persist()
        try:
            for name in measures:
                rows = labelled(groups, name, BY_CORRIDOR, True, config.tz)
                if config.upsert:
                    upsert_batch(rows, config.out_dir, run, batch_id)
                else:
                    save(rows.repartition(PARTITION.name), config, run, batch_id)
        finally:
            if shared:
                groups.unpersist()

    return write


def start_stats(
    config: IngestConfig, positions: DataFrame, measures: tuple[str, ...], name: str
) -> StreamingQuery:
    """Windowed statistics in update mode: a row per window each time it changes."""
    groups = grouped(
        positions, config.window, BY_CORRIDOR, {m: measure(config, m) for m in measures}
    )
    write = stats_sink(config, measures)
    return begin(config, groups, name, "update", lambda w: w.foreachBatch(write).start())


def start_positions_shared(spark: SparkSession, config: IngestConfig) -> StreamingQuery:
    rows = with_partition_day(realtime_positions(spark, config))
    rows = for_files(rows.select(*stored_schema("gpsdata").fieldNames()), config)
    path = sink_path(config.out_dir, "gpsdata")
    return begin(
        config, rows, "positions", "append", lambda w: w.partitionBy(PARTITION.name).format("parquet").start(path)
    )


def start_stats_shared(spark: SparkSession, config: IngestConfig) -> StreamingQuery:
    path, schema = sink_path(config.out_dir, "gpsdata"), stored_schema("gpsdata")
    # A stream cannot start on a folder that is not there yet; this makes an empty one.
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(PARTITION.name).parquet(path)
    reader = spark.readStream.schema(schema)
    if config.stats_max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", config.stats_max_bytes)
    marked = reader.parquet(path).withWatermark("datahora", config.stats_delay or config.delay)
    return start_stats(config, marked, measures_of(config), "stats")


def start_positions(spark: SparkSession, config: IngestConfig) -> StreamingQuery:
    def write(rows: DataFrame, batch_id: int) -> None:
        save(rows, config, query_run(rows), batch_id)

    rows = for_files(realtime_positions(spark, config), config)
    return begin(config, rows, "positions", "update", lambda w: w.foreachBatch(write).start())


def start_speed(spark: SparkSession, config: IngestConfig) -> StreamingQuery:
    return start_stats(config, realtime_positions(spark, config), ("vel_media",), "speed")


def start_vehicles(spark: SparkSession, config: IngestConfig) -> StreamingQuery:
    return start_stats(config, realtime_positions(spark, config), measures_of(config)[1:], "vehicles")


def finish(query: StreamingQuery) -> None:
    """Wait for a bounded run to end; a failure is raised."""
    query.awaitTermination()


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped, over the last hundred reports, which Spark keeps.

    ``streaming.progress`` has those of a query's whole life.
    """
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def run_ingest(spark: SparkSession, config: IngestConfig) -> list[StreamingQuery]:
    """Start the layout's queries.

    A bounded run is over when this returns. Otherwise the queries are running
    and ``wait_all`` waits for them.
    """
    from fleetlens.streaming.routed import start_routed

    layouts = {
        "shared": [start_positions_shared, start_stats_shared],
        "independent": [start_positions, start_speed, start_vehicles],
        "routed": [start_routed],
    }
    if config.layout not in layouts:
        raise ValueError(f"unknown layout {config.layout!r}")
    if config.jdbc_url is not None and config.layout != "independent":
        raise ValueError(f"the {config.layout} layout reads its position files; a database needs 'independent'")
    if config.jdbc_url is not None and config.upsert:
        raise ValueError("a database gets the update log; rows are replaced in path tables only")
    if config.stats_max_bytes is not None and config.stats_delay is None:
        raise ValueError("limited statistics need stats_delay, as long as the event times of one commit of positions")
    bounded, listener = config.trigger == "availableNow", None
    if config.progress_dir is not None:
        listener = ProgressTable(spark, config.progress_dir)
        spark.streams.addListener(listener)
    queries = []
    try:
        for start in layouts[config.layout]:
            query = start(spark, config)
            if bounded:
                (listener.finish if listener else finish)(query)
            queries.append(query)
    finally:
        if listener and bounded:
            spark.streams.removeListener(listener)
    return queries


def wait_all(spark: SparkSession) -> None:
    """Wait for running queries; stop all when one of them fails."""
    try:
        while spark.streams.active:
            spark.streams.awaitAnyTermination()
            spark.streams.resetTerminated()
    finally:
        for query in spark.streams.active:
            query.stop()
