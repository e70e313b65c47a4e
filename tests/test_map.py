"""Recent positions, markers, viewport, pixels, extrema and heat grid."""

import json
import math
from datetime import datetime

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from fleetlens.functions.geo import Viewport, point_radius, round_half_up, world_x, world_y
from fleetlens.operators import heatmap as H
from fleetlens.operators import recent as R
from fleetlens.sources.tables import to_json_rows

GPS = [
    (-22.9, -43.4, "50 - x", 40.0, "TransOlímpica", "2017-08-27 23:57:00"),
    (-22.9, -43.4, "50 - y", 41.0, "TransOlímpica", "2017-08-27 23:57:01"),
    (-22.8, -43.3, "30 - z", 0.0, "TransCarioca", "2017-08-27 23:50:01"),
    (-22.8, -43.3, "10 - w", 12.5, "TransOeste", "2017-08-28 12:00:00"),
    (-22.7, -43.2, "99 - q", None, "", "2017-08-29 00:00:00"),
    (-22.7, -43.2, "99 - q", 1.0, "", None),
]


@pytest.fixture(scope="module")
def gps(spark):
    df = spark.createDataFrame(GPS, "latitude double, longitude double, trajeto string, velocidade double, corredor string, t string")
    return df.withColumn("datahora", F.to_timestamp("t")).drop("t")


def titles(df):
    return [t for (t,) in rows(df, "trajeto")]


def test_three_minutes_strictly_after(gps):
    got = R.recent_positions(gps, "2017-08-28")
    assert got.columns == ["latitude", "longitude", "trajeto", "velocidade", "corredor"]
    assert titles(got) == ["10 - w", "50 - y", "99 - q"]


def test_ten_minutes_and_corridor(gps):
    assert titles(R.recent_positions(gps, "2017-08-28", minutes=10)) == ["10 - w", "30 - z", "50 - x", "50 - y", "99 - q"]
    assert titles(R.recent_positions(gps, datetime(2017, 8, 28), 10, "TransOlímpica")) == ["50 - x", "50 - y"]
    assert titles(R.recent_positions(gps, "2017-08-28", 10, "Linha")) == titles(R.recent_positions(gps, "2017-08-28", 10))
    assert titles(R.recent_positions(gps, "2017-08-28", 10, "x' OR '1'='1")) == []


def test_the_bound_reaches_a_stored_table(spark, gps, tmp_path):
    stored = gps.filter("datahora IS NOT NULL").withColumn("data", F.to_date("datahora"))
    stored.write.partitionBy("data").parquet(str(tmp_path / "gps"))
    got = R.recent_positions(spark.read.parquet(str(tmp_path / "gps")), "2017-08-29", minutes=5)
    plan = plan_of(got)
    assert "GreaterThan(datahora," in plan
    assert "data#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert titles(got) == ["99 - q"]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_recent_rows_in_any_zone(spark, tmp_path, zone):
    from datetime import timezone

    from fleetlens.sources.tables import append, read_table

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        pings = spark.range(0, 48).select(
            F.col("id").cast("string").alias("trajeto"),
            F.timestamp_seconds(F.lit(1503792000) + F.col("id") * 3600).alias("datahora"),
        )
        append(pings, str(tmp_path / "t"))
        gps = read_table(spark, str(tmp_path / "t"), "gpsdata")
        # 2017-08-27 12:00 UTC is the 12th ping, whatever the session's zone
        got = R.recent_positions(gps, datetime(2017, 8, 27, 12, 30, tzinfo=timezone.utc), minutes=60)
        assert sorted(int(t) for t in titles(got)) == list(range(12, 48))
        local = R.recent_positions(gps, "2017-08-28", minutes=60)
        bound = gps.filter(F.col("datahora") > F.lit("2017-08-27 23:00:00").cast("timestamp"))
        assert titles(local) == titles(bound)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_markers_and_their_json(gps):
    got = R.markers(R.recent_positions(gps, "2017-08-28", minutes=10))
    icons = {r.title: r.icon for r in got.collect()}
    assert icons == {
        "50 - x": "../static/transolimpica.png",
        "50 - y": "../static/transolimpica.png",
        "30 - z": "../static/transcarioca.png",
        "10 - w": "../static/transoeste.png",
        "99 - q": None,
    }
    parsed = {p["title"]: p for p in (json.loads(r.json) for r in to_json_rows(got).collect())}
    assert parsed["10 - w"] == {
        "lat": -22.8, "lng": -43.3, "title": "10 - w", "count": 12.5, "icon": "../static/transoeste.png",
    }
    assert parsed["99 - q"]["icon"] is None and parsed["99 - q"]["count"] is None


VIEW = Viewport(north=-22.75, south=-23.0, east=-43.25, west=-43.7, zoom=12)

POINTS = [(-22.75, -43.7, 5.0), (-23.0, -43.25, 7.0), (-22.9, -43.4, 3.0), (-22.74, -43.4, 900.0), (-22.9, -43.8, -900.0)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "lat double, lng double, count double")


def test_viewport_edges_are_inside(points):
    assert rows(H.visible(points, VIEW), "count") == [(3.0,), (5.0,), (7.0,)]


def test_viewport_over_the_date_line(spark):
    view = Viewport(north=10, south=-10, east=-170, west=170, zoom=2)
    df = spark.createDataFrame([(0.0, 175.0, 1.0), (0.0, -175.0, 2.0), (0.0, 0.0, 3.0)], "lat double, lng double, count double")
    got = rows(H.viewport_pixels(df, view), "x", "count")
    # 360 degrees are 1024 pixels at zoom 2
    assert got == [(14, 1.0), (43, 2.0)]


def mercator(lat, lng, zoom):
    size = 256 * 2**zoom
    s = min(max(math.sin(math.radians(lat)), -0.9999), 0.9999)
    return size * (0.5 + lng / 360), size * (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi))


@pytest.mark.parametrize("lat, lng", [(0.0, 0.0), (-22.913767, -43.491655), (89.9, 179.9), (-89.9, -180.0)])
def test_world_pixels(spark, lat, lng):
    got = spark.range(1).select(world_x(F.lit(lng), 12).alias("x"), world_y(F.lit(lat), 12).alias("y")).first()
    x, y = mercator(lat, lng, 12)
    assert got.x == pytest.approx(x, abs=1e-6) and got.y == pytest.approx(y, abs=1e-6)


def test_pixels_against_plain_arithmetic(points):
    x0, y0 = mercator(VIEW.north, VIEW.west, 12)
    want = []
    for lat, lng, count in POINTS[:3]:
        x, y = mercator(lat, lng, 12)
        want.append((math.floor(x - x0 + 0.5), math.floor(y - y0 + 0.5), count, 10.0))
    assert rows(H.viewport_pixels(points, VIEW)) == sorted(want, key=repr)


def test_halves_round_up(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (-1.5,), (1.49,), (2.5,)], "v double")
    assert [r.r for r in df.select(round_half_up(F.col("v")).alias("r")).collect()] == [1, 0, -1, 1, 3]


@pytest.mark.parametrize(
    "default, scale, expected",
    [(10, False, [7.0, 10.0, 10.0, 10.0]), (None, False, [7.0, 2.0, 2.0, 2.0]), (0, True, [56.0, 16.0, 16.0, 16.0])],
)
def test_radius(spark, default, scale, expected):
    df = spark.createDataFrame([(7.0,), (0.0,), (None,), (float("nan"),)], "r double")
    got = df.select(point_radius(F.col("r"), default, 3, scale).alias("r"))
    assert [r.r for r in got.collect()] == expected


def test_extrema_start_at_zero(points):
    assert H.viewport_extrema(points, VIEW).first()[:] == (7.0, 0.0)
    assert H.viewport_extrema(points, VIEW, zero_floor=False).first()[:] == (7.0, 3.0)
    nowhere = Viewport(north=1, south=0, east=1, west=0)
    assert H.viewport_extrema(points, nowhere).first()[:] == (0.0, 0.0)


def test_given_extrema(points):
    given = H.display_extrema(points, VIEW, use_local=False, given_max=100, given_min=1)
    assert given.first()[:] == (100.0, 1.0)
    assert H.display_extrema(points, VIEW, use_local=False, given_max=100).first()[:] == (100.0, -900.0)
    assert H.display_extrema(points, VIEW).first()[:] == (7.0, 0.0)


def test_configurable_fields(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "la double, lo double, v double, r double")
    got = H.located(df, "la", "lo", "v", "r")
    assert got.columns == ["latlng", "v", "radius"]
    assert got.select("latlng.lat", "latlng.lng", "v", "radius").first()[:] == (1.0, 2.0, 3.0, 4.0)
    plain = spark.createDataFrame([(1.0, 2.0, 3.0)], "lat double, lng double, value double")
    assert H.located(plain).columns == ["latlng", "value"]


def test_grid_holds_every_visible_point(spark):
    crowd = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-22.9)).otherwise(F.lit(-23.1) + (F.col("id") % 97) * 0.005).alias("lat"),
        F.when(F.col("id") % 3 == 0, F.lit(-43.4)).otherwise(F.lit(-43.8) + (F.col("id") % 89) * 0.007).alias("lng"),
        (F.col("id") % 50 + F.lit(0.25)).alias("count"),
    )
    grid = H.heat_grid(crowd, VIEW, exact_scale=2)
    seen = H.visible(crowd, VIEW).agg(F.count("*").alias("n"), F.sum("count").alias("s")).first()
    total = grid.agg(F.sum("points").alias("n"), F.sum("intensity").alias("s")).first()
    assert (total.n, total.s) == (seen.n, pytest.approx(seen.s))
    assert grid.agg(F.max("points")).first()[0] >= 1000
    assert "partial_sum" in plan_of(grid)
    cells = {(r.cell_x, r.cell_y) for r in grid.collect()}
    brute = {(r.x // 10, r.y // 10) for r in H.viewport_pixels(crowd, VIEW).collect()}
    assert cells == brute
