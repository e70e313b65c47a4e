"""Registered stream queries with state of their own: sketches, upsert, late pings, progress, charts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fleetlens.operators import dashboards, sketches, stats
from fleetlens.operators.recent import as_moment
from fleetlens.plans import surrogate as S
from fleetlens.plans.feeds import CUTS, slices, stream_config
from fleetlens.plans.registry import register
from fleetlens.plans.table_queries import near
from fleetlens.sources import tables
from fleetlens.sources.upsert import read_current
from fleetlens.streaming import ingest, progress, routed
from fleetlens.streaming.replay import replay, time_cuts

# Pings that come after all others.
SLOW = "event_id % 10 = 0"


@register
def stream_vehicles_day(spark, sf_dir):
    """A day's distinct vehicles from the sketches a stream keeps, all updates of them."""
    config = replace(stream_config(spark), sketch_lg_k=sketches.LG_K)
    replay(slices(spark, sf_dir), config.files_dir, lambda: ingest.run_ingest(spark, config))
    counted = sketches.vehicles_of(tables.read_table(spark, config.out_dir, "stats_sketch"), "data", "corredor")
    exact = S.positions(spark, sf_dir).groupBy(F.to_date("datahora").alias("data"), "corredor")
    keys = ["data", "corredor"]
    return counted.join(exact.agg(F.count_distinct("codigo").alias("exact")), keys, "full").select(*keys, "exact", near())


@register
def stream_upsert(spark, sf_dir):
    """One row per window and corridor, though every batch is handed over twice."""
    config = replace(stream_config(spark), upsert=True)
    sink = ingest.stats_sink(config, ("vel_media",))

    def twice(groups, batch_id):
        groups.persist()
        try:
            sink(groups, batch_id)
            # As after a failure, and with other values, which must not count.
            again = groups.withColumn("vel_media", F.col("vel_media") + 1)
            sink(again, batch_id)
        finally:
            groups.unpersist()

    def run():
        measures = {"vel_media": ingest.measure(config, "vel_media")}
        positions = ingest.realtime_positions(spark, config)
        groups = stats.grouped(positions, config.window, stats.BY_CORRIDOR, measures)
        ingest.finish(ingest.begin(config, groups, "speed", "update", lambda w: w.foreachBatch(twice).start()))

    replay(slices(spark, sf_dir), config.files_dir, run)
    return read_current(spark, config.out_dir, "stats_vel").drop("atualizacao")


def slow_last(spark, sf_dir):
    """The history in two slices, but for a tenth of all pings, which come at the end."""
    edges = ((None, CUTS[0]), (CUTS[0], None))
    parts = [S.snapshots(spark, sf_dir, lo, hi, where=f"NOT ({SLOW})") for lo, hi in edges]
    return [*parts, S.snapshots(spark, sf_dir, where=SLOW)]


@register
def stream_late_table(spark, sf_dir):
    """Pings sent are kept or in the table of late ones; those of the last, open hour are kept."""
    config = replace(stream_config(spark), layout="routed")
    replay(slow_last(spark, sf_dir), config.files_dir, lambda: ingest.run_ingest(spark, config))
    sent = S.positions(spark, sf_dir).groupBy("corredor").agg(F.count("*").alias("sent"))
    found = sent.join(routed.counts(spark, config), "corredor", "left")
    return found.select("corredor", "sent", "kept", "late", (F.col("kept") + F.col("late") == F.col("sent")).alias("whole"))


@register
def stream_routed_speed(spark, sf_dir):
    """Hourly means of all pings that were kept, one row a window."""
    config = replace(stream_config(spark), layout="routed")
    replay(slow_last(spark, sf_dir), config.files_dir, lambda: ingest.run_ingest(spark, config))
    return read_current(spark, config.out_dir, "stats_vel").drop("atualizacao")


@register
def stream_progress(spark, sf_dir):
    """Rows the watermark dropped over several runs of a query, from its recorded reports."""
    config = stream_config(spark)
    path = f"{config.out_dir}/progress"
    first, middle, last = slices(spark, sf_dir, fixed=True)
    with progress.recording(spark, path) as log:
        replay([first, last, middle], config.files_dir, lambda: log.finish(ingest.start_positions(spark, config)))
    own = progress.totals(spark, path).where(F.col("name") == F.lit(f"{config.name_prefix}positions"))
    return own.select(
        F.lit("positions").alias("name"), "dropped_rows", (F.col("batches") >= 3).alias("all_runs")
    )


@register
def stream_rate_limit(spark, sf_dir):
    """A backlog of files taken two at a time: several micro-batches, all rows."""
    config = replace(stream_config(spark), max_files=2, delay="20 days")
    edges = [None, *time_cuts(S.table(spark, sf_dir, "events"), "ts", 5), None]
    parts = [S.snapshots(spark, sf_dir, lo, hi, repeats=True) for lo, hi in zip(edges, edges[1:])]
    replay(parts, config.files_dir, lambda: None)
    path = f"{config.out_dir}/progress"
    with progress.recording(spark, path) as log:
        log.finish(ingest.start_positions(spark, config))
    # Every batch but the last, which may be empty, read at most two files.
    batches = progress.read_progress(spark, path).where("input_rows > 0").count()
    rows = tables.read_table(spark, config.out_dir, "gpsdata").groupBy("corredor").agg(F.count("*").alias("pings"))
    return rows.withColumn("limited", F.lit(2 * batches >= len(parts)))


@register
def stream_chart(spark, sf_dir):
    """From landed snapshots to a chart: ingest, tables, last update of every window, one day."""
    config = stream_config(spark)
    replay(slices(spark, sf_dir), config.files_dir, lambda: ingest.run_ingest(spark, config))
    log = tables.read_table(spark, config.out_dir, "stats_vel")
    until = as_moment(S.ANCHOR).date()
    chart = dashboards.speed_chart(log, S.ANCHOR, until=until, reduce="final")
    per_series = chart.select("categories", F.inline("content"))
    cells = per_series.select("name", F.posexplode(F.arrays_zip("categories", "data")).alias("position", "cell"))
    return cells.select("name", "position", F.col("cell.categories").alias("category"), F.col("cell.data").alias("value"))
