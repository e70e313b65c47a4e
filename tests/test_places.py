"""Order of places, kernel heat, zoom levels and nearest stops against plain Python."""

import math
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fleetlens.functions.geo import Viewport, view_size
from fleetlens.functions.zorder import axis_cell, gather_bits, interleaved, z_key
from fleetlens.operators import nearest
from fleetlens.operators.heatmap import viewport_pixels
from fleetlens.operators.kernel import kernel_heat
from fleetlens.operators.pyramid import heat_pyramid
from fleetlens.sources import clustered

VIEW = Viewport(north=-22.75, south=-23.0, east=-43.2, west=-43.7, zoom=10)


def test_interleaved_bits(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(2**30), rng.randrange(2**30)) for _ in range(200)] + [(0, 0), (2**30 - 1, 0), (0, 2**30 - 1)]
    df = spark.createDataFrame(pairs, "x long, y long").select("x", "y", interleaved(F.col("x"), F.col("y")).alias("k"))
    back = df.select("x", "y", "k", gather_bits(F.col("k")).alias("a"), gather_bits(F.shiftright("k", 1)).alias("b"))
    for r in back.collect():
        assert r.k == sum((r.x >> i & 1) << 2 * i | (r.y >> i & 1) << 2 * i + 1 for i in range(30))
        assert (r.a, r.b) == (r.x, r.y)


def test_keys_at_the_ends_of_the_map(spark):
    df = spark.sql("SELECT * FROM VALUES (90D, 180D), (-90D, -180D), (91D, 400D), (NULL, 1D) AS t(lat, lng)")
    got = [r.k for r in df.select(z_key(F.col("lat"), F.col("lng")).alias("k")).collect()]
    assert got == [2**60 - 1, 0, 2**60 - 1, None]
    cells = spark.range(1).select(axis_cell(F.lit(0.0), -1.0, 1.0, 4).alias("c")).first().c
    assert cells == 8


def positions(spark, count=4000):
    return spark.range(count).selectExpr(
        "CAST(id % 97 AS STRING) AS codigo",
        "'10' AS linha",
        "-23.1D + (id * 7919 % 1000) * 0.0004D AS latitude",
        "-43.8D + (id * 104729 % 1000) * 0.0007D AS longitude",
        "timestamp'2017-08-27 00:00:00Z' + make_dt_interval(0, 0, 0, id * 20) AS datahora",
        "1D AS velocidade",
        "'ida' AS sentido",
        "'x' AS trajeto",
        "'TransOeste' AS corredor",
    )


def scanned(df):
    """Rows the scan gave, before the filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, found = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
    return sum(found)


def test_a_viewport_reads_few_rows_of_clustered_files(spark, tmp_path):
    df, view = positions(spark), Viewport(north=-22.95, south=-22.98, east=-43.4, west=-43.45)
    want = clustered.in_view(df, view).count()
    clustered.write_clustered(df, str(tmp_path / "ordered"), 32)
    ordered = clustered.read_clustered(spark, str(tmp_path / "ordered"))
    df.repartition(32).withColumn("data", F.to_date("datahora")).write.partitionBy("data").parquet(str(tmp_path / "mixed"))
    mixed = spark.read.schema(ordered.schema).parquet(str(tmp_path / "mixed"))
    met, all_met = clustered.files_met(ordered, view).first(), clustered.files_met(mixed, view).first()
    assert met.files >= 32 and met.met * 4 <= met.files
    assert all_met.met * 2 > all_met.files
    seen = {name: clustered.in_view(t, view).select("latitude", "longitude") for name, t in (("o", ordered), ("m", mixed))}
    assert [t.count() for t in seen.values()] == [want, want]
    # Row groups are skipped by their footers: most rows of the mixed files are read, few of the ordered ones.
    assert scanned(seen["o"]) * 3 < scanned(seen["m"])


def test_files_met_across_the_meridian(spark, tmp_path):
    df = positions(spark, 100).withColumn("longitude", F.expr("if(latitude < -22.9, 179.5D, -179.5D)"))
    clustered.write_clustered(df, str(tmp_path), 2)
    rows_ = clustered.read_clustered(spark, str(tmp_path))
    met = clustered.files_met(rows_, Viewport(north=0, south=-30, east=-179, west=179)).first()
    assert met.met == met.files


def test_kernel_heat(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-23.05, -22.7), rng.uniform(-43.75, -43.15), rng.uniform(0, 9), rng.choice([None, 0.0, 3.5, 12.0])) for _ in range(60)]
    points += [points[0], (None, -43.5, 1.0, 2.0)]
    df = spark.createDataFrame(points, "lat double, lng double, count double, size double")
    want, width_height = {}, view_size(VIEW)
    for x, y, v, radius in viewport_pixels(df, VIEW, radius_field="size").collect():
        for cy in range((width_height[1] - 1) // 4 + 1):
            for cx in range((width_height[0] - 1) // 4 + 1):
                share = (((cx + 0.5) * 4 - x) ** 2 + ((cy + 0.5) * 4 - y) ** 2) / radius**2
                if share < 1:
                    heat, n = want.get((cx, cy), (0.0, 0))
                    want[cx, cy] = heat + v * (1 - share), n + 1
    got = {(r.cell_x, r.cell_y): (r.intensity, r.points) for r in kernel_heat(df, VIEW, radius_field="size").collect()}
    assert set(got) == set(want)
    assert all(math.isclose(got[c][0], want[c][0], abs_tol=1e-9) and got[c][1] == want[c][1] for c in want)


def test_view_size(spark):
    corner = spark.createDataFrame([(VIEW.south, VIEW.east, 1.0)], "lat double, lng double, count double")
    x, y, *_ = viewport_pixels(corner, VIEW).first()
    width, height = view_size(VIEW)
    assert 0 <= width - x <= 1 and 0 <= height - y <= 1
    wrapped = Viewport(north=10, south=-10, east=-170, west=170, zoom=0)
    assert view_size(wrapped)[0] == math.ceil(256 * 20 / 360)


def test_every_zoom_level_is_a_grid_of_its_own(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-85, 85), rng.uniform(-180, 180), rng.uniform(0, 5)) for _ in range(300)]
    points += [(0.0, 180.0, 1.0), (89.9, -180.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(points, "lat double, lng double, count double")
    levels = heat_pyramid(df, 12, 1).collect()
    for zoom in (1, 5, 12):
        direct = {(r.tile_x, r.tile_y): r.points for r in heat_pyramid(df, zoom, zoom).collect()}
        rolled = {(r.tile_x, r.tile_y): r.points for r in levels if r.zoom == zoom}
        assert rolled == direct and sum(rolled.values()) == 302
    for r in levels:
        digits = "".join(str((r.tile_x >> i & 1) + 2 * (r.tile_y >> i & 1)) for i in range(r.zoom - 1, -1, -1))
        assert r.quadkey == digits


def test_points_of_a_pyramid_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1.0, 1.0, 1.0)], "lat double, lng double, count double").write.parquet(str(tmp_path / "p"))
    plan = heat_pyramid(spark.read.parquet(str(tmp_path / "p")), 14, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


PLACES = "estacao string, latitude double, longitude double, linha string"


def brute(positions_, places, squeeze, keyed=False):
    out = {}
    for name, lat, lng, line in positions_:
        found = [
            ((lat - a) ** 2 + (lng - b) ** 2 * squeeze, place)
            for place, a, b, own in places
            if None not in (lat, lng, a, b, place) and (not keyed or own == line)
        ]
        out[name] = min(found)[1] if found else None
    return out


@pytest.mark.parametrize("keyed", [False, True])
def test_nearest_place(spark, keyed):
    rng = random.Random(4)
    spot = lambda: (-22.9 + rng.gauss(0, 0.1), -43.4 + rng.gauss(0, 0.1))
    places = [(f"s{i}", *spot(), str(i % 3)) for i in range(80)]
    # Equally near, far away, without coordinates, on the edge of a cell.
    places += [("t1", -22.5, -43.0, "0"), ("t0", -22.5, -43.0, "0"), ("far", 60.0, 100.0, "2"), ("no", None, -43.0, "0"), ("edge", -22.9, -43.4, "1")]
    points = [(f"p{i}", *spot(), str(i % 4)) for i in range(200)]
    points += [("a", -22.5, -43.0, "0"), ("b", None, -43.0, "0"), ("c", 59.0, 99.0, "2"), ("d", -89.0, 179.0, "1"), ("e", -22.9, -43.4, "1")]
    df = spark.createDataFrame(points, PLACES).withColumnRenamed("estacao", "name")
    near = nearest.with_nearest(df, spark.createDataFrame(places, PLACES), "estacao", ("linha",) if keyed else (), latitude=-22.9)
    got = {r.name: r.estacao for r in near.collect()}
    assert got == brute(points, places, nearest.squeeze_at(-22.9), keyed)


def test_pairs_are_not_sorted_and_a_spot_is_one_place(spark, monkeypatch):
    plans, sizes = [], []

    def noted(df, purpose):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = staged(df, purpose)
        sizes.append(out.count())
        return out

    staged = nearest.staged
    monkeypatch.setattr(nearest, "staged", noted)
    pings = spark.range(50).select((F.col("id") / 1000).alias("latitude"), F.lit(0.0).alias("longitude"))
    crowd = spark.range(300).selectExpr("concat('s', lpad(id, 3, '0')) AS estacao", "0.001D * (id % 2) AS latitude", "0.01D AS longitude")
    near = nearest.with_nearest(pings, crowd, "estacao").collect()
    assert sorted((r.latitude, r.estacao) for r in near)[:2] == [(0.0, "s000"), (0.001, "s001")]
    assert {r.estacao for r in near} == {"s000", "s001"}
    # Pairs of positions and places would be sorted, and spilled, for the least of a structure with a text.
    assert sizes[1] == 2 and not any("min(struct" in plan for plan in plans)


def test_no_places_and_no_positions(spark):
    some = spark.createDataFrame([("p", 1.0, 1.0, "1")], PLACES)
    none = some.limit(0)
    assert [r.estacao for r in nearest.with_nearest(some.drop("estacao"), none, "estacao").collect()] == [None]
    assert nearest.with_nearest(none.drop("estacao"), some, "estacao").count() == 0


def test_next_stop(spark):
    stops = [(1, "A", 0.0), (2, "B", 1.0), (3, "A", 0.0), (4, "C", 2.0)]
    itinerary = spark.createDataFrame([("10", "ida", n, s, 0.0, x) for n, s, x in stops] + [("10", "volta", 1, "C", 0.0, 2.0)], "linha string, sentido string, sequencia int, estacao string, latitude double, longitude double")
    pings = spark.createDataFrame(
        [("v", "10", "ida", 0.0, 0.1), ("w", "10", "ida", 0.0, 1.2), ("x", "10", "ida", 0.0, 5.0), ("y", "10", "volta", 0.0, 0.0), ("z", "99", "ida", 0.0, 0.0)],
        "codigo string, linha string, sentido string, latitude double, longitude double",
    )
    found = nearest.next_stops(pings, itinerary).select("codigo", "estacao", "proxima")
    assert rows(found) == [("v", "A", "B"), ("w", "B", "A"), ("x", "C", None), ("y", "C", None), ("z", None, None)]
