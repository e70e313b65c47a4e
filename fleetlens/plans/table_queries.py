"""Registered queries of table upkeep: archive by day, sketches that add up."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.operators import sketches
from fleetlens.plans import surrogate as S
from fleetlens.plans.registry import register
from fleetlens.session import scratch_dir
from fleetlens.sources import archive, tables


@register
def gps_table_archive(spark, sf_dir):
    """Every row once, from archives that grow, overlap and leave days out, with rows that come late."""
    root, history = scratch_dir(spark, "tables"), scratch_dir(spark, "archive")
    rows = S.positions(spark, sf_dir)
    late = F.minute("datahora") % 10 == 0
    tables.append(rows.where(~late), root)
    first = date(1970, 1, 1)
    for since, before in ((first, date(2024, 1, 10)), (first, date(2024, 1, 15)), (date(2024, 1, 12), date(2024, 1, 25))):
        archive.archive(spark, root, "gpsdata", history, since, before)
    # Days that are archived get more rows; some of them are archived again, and originals go.
    tables.append(rows.where(late), root)
    archive.archive(spark, root, "gpsdata", history, date(2024, 1, 5), date(2024, 1, 8))
    archive.remove_archived(spark, root, "gpsdata", history)
    found = archive.read_archived(spark, root, "gpsdata", history)
    return found.groupBy("data", "corredor").agg(F.count("*").alias("pings"))


def near(errors: int = 3) -> Column:
    """Within so many standard errors of the sketch, or one vehicle."""
    return F.expr(f"abs(qtd_carros - exact) <= greatest(1.0D, {errors * sketches.relative_error()}D * exact)").alias("close")


def sketch_table(spark, sf_dir):
    """Hourly sketches written to their table and read back."""
    root = scratch_dir(spark, "tables")
    tables.append(sketches.window_sketches(S.positions(spark, sf_dir)), root)
    return tables.read_table(spark, root, "stats_sketch")


@register
def vehicles_day_sketched(spark, sf_dir):
    """A day's distinct vehicles from the sketches of its hours."""
    keys = ["data", "corredor"]
    counted = sketches.vehicles_of(sketch_table(spark, sf_dir), *keys)
    exact = S.positions(spark, sf_dir).groupBy(F.to_date("datahora").alias("data"), "corredor")
    return counted.join(exact.agg(F.count_distinct("codigo").alias("exact")), keys, "full").select(*keys, "exact", near())


@register
def vehicles_rollup_sketched(spark, sf_dir):
    """Distinct vehicles of each day and corridor, of each corridor and of all, from the same sketches."""
    keys = ["corredor", "data"]
    counted = sketches.vehicles_rollup(sketch_table(spark, sf_dir), *keys)
    rows = S.positions(spark, sf_dir).select("corredor", F.to_date("datahora").alias("data"), "codigo")
    level = (F.lit(2) - F.expr("bit_count(grouping_id())")).cast("int").alias("level")
    exact = rows.rollup(*keys).agg(level, F.count_distinct("codigo").alias("exact"))
    same = F.lit(True)
    for name in (*keys, "level"):
        same = same & counted[name].eqNullSafe(exact[name])
    both = counted.join(exact, same)
    return both.select(exact.corredor, exact.data, exact.level, "exact", near())
