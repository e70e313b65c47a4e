"""The registered queries: one per operator, over the test tables.

Those of the map, of table upkeep and of streaming state have modules of their own.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.geo import Viewport
from fleetlens.functions.vehicle import corridor_icon, mean
from fleetlens.operators import dashboards, dimensions, heatmap, recent, stats, yearly
from fleetlens.operators.positions import clean_snapshots, dedupe
from fleetlens.plans import map_queries, state_queries, table_queries  # noqa: F401
from fleetlens.plans import surrogate as S
from fleetlens.plans.feeds import slices, stream_config
from fleetlens.plans.registry import QUERIES, before, plain_times, register  # noqa: F401
from fleetlens.schemas import STATION, append_to_catalog, create_tables
from fleetlens.session import scratch_dir
from fleetlens.sources import snapshots as snap
from fleetlens.sources import stations as places
from fleetlens.sources import tables
from fleetlens.sources.paths import spread
from fleetlens.streaming import ingest
from fleetlens.streaming.extrema import running_extrema
from fleetlens.streaming.replay import replay

VIEW = Viewport(north=-22.75, south=-23.0, east=-43.2, west=-43.7, zoom=12)
WRAPPED_VIEW = Viewport(north=-22.8, south=-23.1, east=-43.6, west=-43.3, zoom=3)

# Relative error of the checked sketches (the default).
RSD = 0.05


def close_enough(errors: int = 6) -> Column:
    """Sketch within so many standard errors of the exact count, or one vehicle."""
    return F.expr(f"abs(approx - exact) <= greatest(1.0D, {errors * RSD}D * exact)")


# Snapshots to positions


@register
def clean_positions(spark, sf_dir):
    return plain_times(clean_snapshots(S.snapshots(spark, sf_dir)))


@register
def snapshot_scan(spark, sf_dir):
    """Snapshots landed as JSON by day, read back with the time in their path."""
    landing = scratch_dir(spark, "snapshots")
    docs = S.snapshots(spark, sf_dir, repeats=True)
    day = F.date_trunc("day", F.timestamp_millis(F.col("veiculos")[0].datahora.cast("long")))
    landed = docs.withColumn("landed", F.date_format(day, "yyyyMMddHHmmss"))
    spread(landed, "landed").write.partitionBy("landed").json(landing)
    read = snap.with_snapshot_time(snap.read_snapshots(spark, landing), r"landed=(\d{14})")
    per_doc = read.select("snapshot_ts", F.explode("veiculos").alias("v"))
    return plain_times(
        per_doc.groupBy("snapshot_ts").agg(
            F.count("*").alias("records"), F.count_distinct("v.codigo").alias("vehicles")
        )
    )


@register
def corridor_counts(spark, sf_dir):
    return stats.corridor_counts(S.positions(spark, sf_dir))


@register
def dedupe_replay(spark, sf_dir):
    return plain_times(dedupe(clean_snapshots(S.snapshots(spark, sf_dir, repeats=True))))


# Windowed statistics


@register
def speed_10m(spark, sf_dir):
    return stats.window_speed(S.positions(spark, sf_dir), exact_scale=S.SCALE).drop("atualizacao")


@register
def speed_1h(spark, sf_dir):
    unique = dedupe(S.positions(spark, sf_dir).select("codigo", "datahora", "corredor", "velocidade"))
    return stats.window_speed(unique, C.STREAM_WINDOW, positive_only=True, exact_scale=S.SCALE).drop("atualizacao")


@register
def vehicles_10m_exact(spark, sf_dir):
    return stats.window_vehicles(S.positions(spark, sf_dir)).drop("atualizacao")


@register
def speed_10m_plain(spark, sf_dir):
    """The mean a user gets by default, in doubles, against the one of exact decimals."""
    rows = S.positions(spark, sf_dir)
    means = {"plain": mean(F.col("velocidade")), "exact": mean(F.col("velocidade"), S.SCALE)}
    groups = stats.grouped(rows, C.BATCH_WINDOW, ("corredor",), means)
    close = F.expr("abs(plain - exact) <= 1e-9D * greatest(1.0D, abs(exact))").alias("close")
    return groups.select(F.col("window.start").alias("window_start"), "corredor", close)


@register
def vehicles_1h_approx(spark, sf_dir):
    """Sketched counts of every window next to the exact ones."""
    rows = S.positions(spark, sf_dir)
    sketched = stats.window_vehicles(rows, C.STREAM_WINDOW, positive_only=True, approx=True, rsd=RSD)
    return next_to_exact(rows, sketched)


def next_to_exact(rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """Each window's exact count, and whether the sketched one is near it."""
    keys = ["data", "hora", "corredor"]
    approx = sketched.select(*keys, F.col("qtd_carros").alias("approx"))
    exact = stats.window_vehicles(rows, C.STREAM_WINDOW).withColumnRenamed("qtd_carros", "exact")
    return exact.join(approx, keys, "full").select(*keys, "exact", close_enough().alias("close"))


@register
def vehicles_1h_approx_error(spark, sf_dir):
    """Error of the sketches over all windows.

    About 0.3 % of normal errors are beyond three standard errors; 1 % are allowed.
    """
    groups = stats.grouped(
        S.positions(spark, sf_dir),
        C.STREAM_WINDOW,
        ("corredor",),
        {"exact": stats.vehicle_count(), "approx": stats.vehicle_count(approx=True, rsd=RSD)},
    )
    far = F.count_if(~close_enough(3))
    error = F.avg(F.expr("abs(approx - exact) / CAST(exact AS DOUBLE)"))
    return groups.agg(
        F.count("*").alias("windows"),
        (far * 100 <= F.count("*")).alias("few_far"),
        (error <= RSD).alias("mean_error_small"),
    )


@register
def vehicles_1h_known(spark, sf_dir):
    """Windows in which no vehicle is known are left out."""
    vehicle = F.when(F.col("codigo").cast("long") % 4 == 0, F.col("codigo"))
    rows = S.positions(spark, sf_dir).withColumn("codigo", vehicle)
    return stats.window_vehicles(rows, C.STREAM_WINDOW, positive_only=True).drop("atualizacao")


@register
def stats_update_time(spark, sf_dir):
    """Every row of both logs carries the time it was computed at."""
    rows, started = S.positions(spark, sf_dir), F.lit(datetime.now(timezone.utc))
    logs = [log.select("corredor", "data", "hora", (F.col("atualizacao") >= started).alias("updated")) for log in stats.batch_stats(rows, C.STREAM_WINDOW)]
    return logs[0].unionByName(logs[1])


@register
def stats_by_line(spark, sf_dir):
    return stats.combined_stats(S.positions(spark, sf_dir), exact_scale=S.SCALE).drop("datahora")


@register
def stats_rollup(spark, sf_dir):
    return stats.stats_rollup(S.positions(spark, sf_dir), exact_scale=S.SCALE)


# Charts


def speed_days(spark, sf_dir, days):
    """The speed log from the first hour a chart of so many days may show."""
    return S.speed_log(spark, sf_dir, before(days=days))


def vehicle_days(spark, sf_dir, days):
    return S.vehicle_log(spark, sf_dir, before(days=days))


@register
def speed_by_hour(spark, sf_dir):
    return dashboards.speed_by_hour(speed_days(spark, sf_dir, C.HOUR_VIEW_DAYS), S.ANCHOR)


@register
def speed_by_hour_final(spark, sf_dir):
    return dashboards.speed_by_hour(speed_days(spark, sf_dir, C.HOUR_VIEW_DAYS), S.ANCHOR, reduce="final")


@register
def speed_by_day(spark, sf_dir):
    return dashboards.speed_by_day(speed_days(spark, sf_dir, C.SPEED_VIEW_DAYS), S.ANCHOR)


@register
def vehicles_by_hour(spark, sf_dir):
    return dashboards.vehicles_by_hour(vehicle_days(spark, sf_dir, C.HOUR_VIEW_DAYS), S.ANCHOR)


@register
def vehicles_by_day(spark, sf_dir):
    return dashboards.vehicles_by_day(vehicle_days(spark, sf_dir, C.VEHICLE_VIEW_DAYS), S.ANCHOR)


def speed_rows(spark, sf_dir, days):
    return dashboards.chart_rows(speed_days(spark, sf_dir, days), "vel_media", S.ANCHOR, days)


def vehicle_rows(spark, sf_dir, days):
    return dashboards.chart_rows(vehicle_days(spark, sf_dir, C.VEHICLE_VIEW_DAYS), "qtd_carros", S.ANCHOR, days)


@register
def speed_series_hour(spark, sf_dir):
    return dashboards.series(speed_rows(spark, sf_dir, C.HOUR_VIEW_DAYS), "vel_media", dashboards.HOUR)


@register
def speed_series_day(spark, sf_dir):
    return dashboards.series(speed_rows(spark, sf_dir, C.SPEED_VIEW_DAYS), "vel_media", dashboards.DAY)


@register
def vehicle_series_hour(spark, sf_dir):
    return dashboards.series(vehicle_rows(spark, sf_dir, C.HOUR_VIEW_DAYS), "qtd_carros", dashboards.HOUR)


@register
def vehicle_series_day(spark, sf_dir):
    return dashboards.series(vehicle_rows(spark, sf_dir, C.VEHICLE_VIEW_DAYS), "qtd_carros", dashboards.DAY)


@register
def categories_hour(spark, sf_dir):
    return dashboards.categories(vehicle_rows(spark, sf_dir, C.HOUR_VIEW_DAYS), dashboards.HOUR)


@register
def categories_day(spark, sf_dir):
    return dashboards.categories(vehicle_rows(spark, sf_dir, C.VEHICLE_VIEW_DAYS), dashboards.DAY)


@register
def speed_chart(spark, sf_dir):
    """The chart's arrays, taken apart again to rows."""
    chart = dashboards.speed_chart(speed_days(spark, sf_dir, C.SPEED_VIEW_DAYS), S.ANCHOR, per_day=False)
    per_series = chart.select("categories", F.inline("content"))
    cells = per_series.select("name", F.posexplode(F.arrays_zip("categories", "data")).alias("position", "cell"))
    return cells.select(
        "name", "position", F.col("cell.categories").alias("category"), F.col("cell.data").alias("value")
    )


@register
def vehicle_chart_json(spark, sf_dir):
    return tables.to_json_rows(dashboards.vehicle_chart(vehicle_days(spark, sf_dir, C.HOUR_VIEW_DAYS), S.ANCHOR))


# Positions and heat map


def lately(spark, sf_dir, minutes=C.RECENT_MINUTES, corridor=None):
    rows = S.positions(spark, sf_dir, before(minutes=minutes))
    return recent.markers(recent.recent_positions(rows, S.ANCHOR, minutes, corridor))


@register
def recent_positions_3m(spark, sf_dir):
    return lately(spark, sf_dir)


@register
def recent_positions_corridor(spark, sf_dir):
    return lately(spark, sf_dir, corridor=C.TRANS_OLIMPICA)


@register
def marker_json(spark, sf_dir):
    return tables.to_json_rows(lately(spark, sf_dir).select("title", "icon"))


@register
def heat_points_10m(spark, sf_dir):
    return heatmap.heat_points(lately(spark, sf_dir, C.HEAT_MINUTES, C.ALL_CORRIDORS))


@register
def heat_points_corridor(spark, sf_dir):
    return heatmap.heat_points(lately(spark, sf_dir, C.HEAT_MINUTES, C.TRANS_CARIOCA))


@register
def located_points(spark, sf_dir):
    rows = heatmap.located(S.positions(spark, sf_dir), "latitude", "longitude", "velocidade")
    return rows.select("latlng.lat", "latlng.lng", "velocidade")


@register
def viewport_pixels(spark, sf_dir):
    rows = S.points(spark, sf_dir).withColumn("size", F.when(F.col("count") > 50, F.col("count")))
    return heatmap.viewport_pixels(rows, VIEW, radius_field="size")


@register
def viewport_wrapped(spark, sf_dir):
    return heatmap.viewport_pixels(S.points(spark, sf_dir), WRAPPED_VIEW, default_radius=None, scale_radius=True)


@register
def viewport_extrema(spark, sf_dir):
    return heatmap.viewport_extrema(S.points(spark, sf_dir), VIEW)


@register
def given_extrema(spark, sf_dir):
    return heatmap.display_extrema(S.points(spark, sf_dir), VIEW, use_local=False, given_max=100.0)


@register
def heat_grid(spark, sf_dir):
    return heatmap.heat_grid(S.points(spark, sf_dir), VIEW, exact_scale=S.SCALE)


# Dimensions


@register
def stations_union(spark, sf_dir):
    """Three sources landed as JSON, scanned, joined in one bag, coordinates as numbers."""
    landing = scratch_dir(spark, "stations")
    read = {}
    for name, df in S.stations(spark, sf_dir).items():
        df.write.json(f"{landing}/{name}")
        read[name] = places.read_stations(spark, f"{landing}/{name}", multi_line=False)
    return places.with_coordinates(places.union_stations(read)).select(*STATION.fieldNames(), "source")


@register
def station_markers(spark, sf_dir):
    rows = places.station_markers(places.union_stations(S.stations(spark, sf_dir)))
    return rows.select("position.lat", "position.lng", "title", "icon")


@register
def line_group_join(spark, sf_dir):
    tagged = dimensions.tag_groups(S.positions(spark, sf_dir))
    return tagged.groupBy("grupo", "linha").agg(F.count("*").alias("pings"))


@register
def line_semi(spark, sf_dir):
    rows = dimensions.in_groups(S.positions(spark, sf_dir), "transolimpica", "lote_zero")
    return rows.select("codigo", "datahora", "linha", "trajeto")


@register
def line_flat_list(spark, sf_dir):
    return dimensions.in_all_lines(S.positions(spark, sf_dir)).groupBy("linha").agg(F.count("*").alias("pings"))


@register
def icon_lookup(spark, sf_dir):
    rows = dimensions.with_icon(S.positions(spark, sf_dir))
    by_rule = rows.withColumn("icon_rule", corridor_icon("corredor"))
    return by_rule.groupBy("corredor", "icon", "icon_rule").agg(F.count("*").alias("pings"))


@register
def itinerary_stations(spark, sf_dir):
    named = places.with_coordinates(S.stations(spark, sf_dir)["supplier"])
    return dimensions.itinerary_stations(S.itinerary(spark, sf_dir), named)


# Tables


@register
def gps_table(spark, sf_dir):
    """Positions appended to the table, then the recent ones from its last days only."""
    root = scratch_dir(spark, "tables")
    tables.append(S.positions(spark, sf_dir), root)
    gps = tables.read_table(spark, root, "gpsdata")
    return recent.recent_positions(gps, S.ANCHOR, minutes=24 * 60)


@register
def gps_table_scan(spark, sf_dir):
    """A batch written twice counts once; two batches add up."""
    root = scratch_dir(spark, "tables")
    rows = S.positions(spark, sf_dir)
    tables.write_batch(rows, root, run_id="a", batch_id=0)
    tables.write_batch(rows, root, run_id="a", batch_id=0)
    tables.write_batch(rows, root, run_id="a", batch_id=1)
    return tables.read_table(spark, root, "gpsdata").groupBy("data", "corredor").agg(F.count("*").alias("pings"))


@register
def gps_catalog(spark, sf_dir):
    """Catalog tables: created, appended to twice, read by day."""
    place = scratch_dir(spark, "catalog")
    database = f"fleet_{place.rsplit('-', 1)[-1]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{place}'")
    create_tables(spark, database)
    for _ in range(2):
        append_to_catalog(S.positions(spark, sf_dir), "gpsdata", database)
    days = spark.table(f"{database}.gpsdata").where(F.col("data") >= F.lit(recent.as_moment(S.ANCHOR).date()))
    return days.groupBy("data", "corredor").agg(F.count("*").alias("pings"))


@register
def stats_tables(spark, sf_dir):
    """Both logs routed to their tables by columns, charted from there."""
    root = scratch_dir(spark, "tables")
    tables.append(S.speed_log(spark, sf_dir), root)
    tables.append(S.vehicle_log(spark, sf_dir), root)
    speed = dashboards.speed_by_day(tables.read_table(spark, root, "stats_vel"), S.ANCHOR)
    count = dashboards.vehicles_by_day(tables.read_table(spark, root, "stats_qtd"), S.ANCHOR)
    return speed.join(count, ["data", "corredor", "label"], "full").select(
        "data", "label", "corredor", "vel_media", "qtd_carros"
    )


# Streams


@register
def stream_positions(spark, sf_dir):
    """Replay through the positions query, restarted after every slice."""
    config = stream_config(spark)
    replay(
        slices(spark, sf_dir),
        config.files_dir,
        lambda: ingest.finish(ingest.start_positions_shared(spark, config)),
    )
    return plain_times(tables.read_table(spark, config.out_dir, "gpsdata")).drop("data")


@register
def stream_speed_1h(spark, sf_dir):
    """Shared layout: last update of every window in the speed log."""
    config = stream_config(spark)
    replay(slices(spark, sf_dir), config.files_dir, lambda: ingest.run_ingest(spark, config))
    log = tables.read_table(spark, config.out_dir, "stats_vel")
    return dashboards.last_update(log, "vel_media")


@register
def stream_speed_log(spark, sf_dir):
    """Independent speed query: the whole update log, interim means included."""
    config = stream_config(spark)
    parts = slices(spark, sf_dir, fixed=True)
    replay(parts, config.files_dir, lambda: ingest.finish(ingest.start_speed(spark, config)))
    return tables.read_table(spark, config.out_dir, "stats_vel").drop("atualizacao")


@register
def stream_vehicles_1h(spark, sf_dir):
    """Independent vehicle query: last count of every window, against the exact one."""
    config = replace(stream_config(spark), rsd=RSD)
    replay(slices(spark, sf_dir), config.files_dir, lambda: ingest.finish(ingest.start_vehicles(spark, config)))
    log = tables.read_table(spark, config.out_dir, "stats_qtd")
    return next_to_exact(S.positions(spark, sf_dir), dashboards.last_update(log, "qtd_carros"))


@register
def stream_late_drop(spark, sf_dir):
    """The middle slice lands last: all of it is older than the watermark by then."""
    config = stream_config(spark)
    first, middle, last = slices(spark, sf_dir, fixed=True)
    replay(
        [first, last, middle], config.files_dir, lambda: ingest.finish(ingest.start_positions(spark, config))
    )
    return plain_times(tables.read_table(spark, config.out_dir, "gpsdata")).drop("data")


@register
def stream_extrema(spark, sf_dir):
    """Running extrema as points are added, the latest kept."""
    config = stream_config(spark)
    out = f"{config.out_dir}/extrema"

    def run() -> None:
        rows = clean_snapshots(snap.stream_snapshots(spark, config.files_dir, max_files=None))
        extremes = running_extrema(heatmap.heat_points(rows, "latitude", "longitude", "velocidade"))
        save = lambda w: w.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
        ingest.finish(ingest.begin(config, extremes, "extrema", "complete", save))

    replay(slices(spark, sf_dir), config.files_dir, run)
    return spark.read.schema("max double, min double").parquet(out)


# Year-keyed objects


@register
def props_map_rows(spark, sf_dir):
    props = S.table(spark, sf_dir, "events").select(
        "event_id", F.explode(F.from_json("props", "map<string, int>")).alias("key", "value")
    )
    return props


@register
def year_rows(spark, sf_dir):
    return yearly.year_rows(S.year_objects(spark, sf_dir), "body", ("o_orderkey",))


@register
def year_extent(spark, sf_dir):
    return yearly.year_extent(yearly.year_rows(S.year_objects(spark, sf_dir), "body"))


@register
def year_range(spark, sf_dir):
    rows = yearly.year_rows(S.country_years(spark, sf_dir), "body", ("o_orderkey", "country"))
    return yearly.year_range(rows, "NATION_3", 1996, 1998, ("internet", "human"))
