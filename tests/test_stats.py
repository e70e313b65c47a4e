"""Windowed statistics."""

from datetime import date, datetime

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from fleetlens.operators import stats

DATA = [
    ("A", "2017-08-27 10:00:00", "TransOeste", "10", "ida", 40.0),
    ("A", "2017-08-27 10:09:59", "TransOeste", "10", "ida", 20.0),
    ("B", "2017-08-27 10:10:00", "TransOeste", "10", "volta", 30.0),
    ("C", "2017-08-27 10:30:00", "TransCarioca", "33", "ida", 0.0),
    ("D", "2017-08-27 10:30:00", "", "99", "ida", None),
    (None, "2017-08-27 11:00:00", "TransOeste", "11", "ida", 8.0),
    ("A", "2017-08-28 00:30:00", "TransOeste", "10", "ida", 10.0),
]


@pytest.fixture(scope="module")
def positions(spark):
    df = spark.createDataFrame(
        DATA, "codigo string, t string, corredor string, linha string, sentido string, velocidade double"
    )
    return df.withColumn("datahora", F.to_timestamp("t")).drop("t")


def test_ten_minute_speed(positions):
    got = stats.window_speed(positions)
    assert got.columns == ["corredor", "vel_media", "data", "hora", "atualizacao"]
    assert rows(got, "hora", "corredor", "vel_media") == [
        ("00:30", "TransOeste", 10.0),
        ("10:00", "TransOeste", 30.0),
        ("10:10", "TransOeste", 30.0),
        ("10:30", "", None),
        ("10:30", "TransCarioca", 0.0),
        ("11:00", "TransOeste", 8.0),
    ]


def test_hourly_positive_means_only(positions):
    got = stats.window_speed(positions, "1 hour", positive_only=True)
    assert rows(got, "data", "hora", "corredor", "vel_media") == [
        (date(2017, 8, 27), "10:00", "TransOeste", 30.0),
        (date(2017, 8, 27), "11:00", "TransOeste", 8.0),
        (date(2017, 8, 28), "00:00", "TransOeste", 10.0),
    ]


def test_exact_vehicles_with_and_without_empty_groups(positions):
    every = stats.window_vehicles(positions, "1 hour")
    assert rows(every, "hora", "corredor", "qtd_carros") == [
        ("00:00", "TransOeste", 1),
        ("10:00", "", 1),
        ("10:00", "TransCarioca", 1),
        ("10:00", "TransOeste", 2),
        ("11:00", "TransOeste", 0),
    ]
    counted = stats.window_vehicles(positions, "1 hour", positive_only=True)
    assert ("11:00", "TransOeste", 0) not in rows(counted, "hora", "corredor", "qtd_carros")


def test_labels_in_another_time_zone(positions):
    got = stats.window_speed(positions, "1 hour", positive_only=True, tz="America/Sao_Paulo")
    assert rows(got, "data", "hora", "vel_media") == [
        (date(2017, 8, 27), "07:00", 30.0),
        (date(2017, 8, 27), "08:00", 8.0),
        (date(2017, 8, 27), "21:00", 10.0),
    ]


def test_combined_stats(positions):
    got = stats.combined_stats(positions)
    assert got.columns == [
        "window_start", "window_end", "corredor", "linha", "sentido", "vel_media", "qtd_carros", "datahora",
    ]
    one = got.filter("corredor = 'TransOeste' AND sentido = 'volta'").first()
    assert (one.window_start, one.window_end) == (datetime(2017, 8, 27, 10), datetime(2017, 8, 27, 11))
    assert (one.vel_media, one.qtd_carros) == (30.0, 1)


def test_rollup_levels(positions):
    got = stats.stats_rollup(positions)
    ten = got.filter("hour(window_start) = 10")
    assert rows(ten.filter("level = 0"), "corredor", "vel_media", "qtd_carros") == [(None, 22.5, 4)]
    assert rows(ten.filter("level = 1"), "corredor", "vel_media", "qtd_carros") == [
        ("", None, 1),
        ("TransCarioca", 0.0, 1),
        ("TransOeste", 30.0, 2),
    ]
    assert ten.filter("level = 3").count() == 4
    # the finest level is the combined statistics
    finest = rows(got.filter("level = 3"), "window_start", "corredor", "linha", "sentido", "vel_media", "qtd_carros")
    assert finest == rows(
        stats.combined_stats(positions), "window_start", "corredor", "linha", "sentido", "vel_media", "qtd_carros"
    )


def test_approximate_count_is_near(spark):
    many = spark.range(40000).select(
        F.col("id").cast("string").alias("codigo"),
        F.timestamp_seconds(F.lit(1503828000) + F.col("id") % 3600).alias("datahora"),
        F.lit("TransOeste").alias("corredor"),
    )
    got = stats.window_vehicles(many, "1 hour", approx=True, rsd=0.02).first().qtd_carros
    assert abs(got - 40000) <= 6 * 0.02 * 40000


def test_one_corridor_with_most_rows_is_reduced_before_the_shuffle(positions):
    plan = plan_of(stats.window_speed(positions, "1 hour"))
    assert plan.count("Exchange") == 1 and "partial_avg" in plan
    plan = plan_of(stats.window_vehicles(positions, "1 hour"))
    # distinct vehicles are spread by vehicle first, then counted
    assert plan.count("Exchange") == 2 and "hashpartitioning(window" in plan and "codigo" in plan


def test_corridors_partition_the_rows(positions):
    assert sum(r.pings for r in stats.corridor_counts(positions).collect()) == len(DATA)


def test_batch_stats_pair(positions):
    speed, vehicles = stats.batch_stats(positions)
    assert "vel_media" in speed.columns and "qtd_carros" in vehicles.columns
    assert speed.count() == vehicles.count()


def test_rollup_against_plain_counting(spark):
    import random
    from collections import defaultdict

    rng = random.Random(5)
    data = [
        (
            rng.choice(["A", "B", "C", "D", None]),
            f"2017-08-27 {rng.choice(['10', '11'])}:{rng.randrange(60):02d}:00",
            rng.choice(["TransOeste", "", None]),
            rng.choice(["10", "11", None]),
            rng.choice(["ida", "volta"]),
            rng.choice([None, 1.0, 2.5, 40.0]),
        )
        for _ in range(400)
    ]
    df = spark.createDataFrame(
        data, "codigo string, t string, corredor string, linha string, sentido string, velocidade double"
    ).withColumn("datahora", F.to_timestamp("t"))
    speeds, vehicles = defaultdict(list), defaultdict(set)
    for codigo, t, *levels, speed in data:
        for level in range(4):
            key = (t[11:13], *levels[:level], *[None] * (3 - level), level)
            speeds[key] += [] if speed is None else [speed]
            vehicles[key] |= set() if codigo is None else {codigo}
    want = {k: (round(sum(v) / len(v), 9) if v else None, len(vehicles[k])) for k, v in speeds.items()}
    got = {
        (r.h, r.corredor, r.linha, r.sentido, r.level): (r.vel_media and round(r.vel_media, 9), r.qtd_carros)
        for r in stats.stats_rollup(df).withColumn("h", F.date_format("window_start", "HH")).collect()
    }
    assert got == want
