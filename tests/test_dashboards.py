"""Chart queries over a hand-made log."""

import json
from datetime import date, datetime

import pytest
from helpers import rows

from fleetlens.operators import dashboards as D
from fleetlens.schemas import STATS_QTD, STATS_VEL
from fleetlens.sources.tables import to_json_rows

ANCHOR = "2017-08-28"


def at(hour, minute, day=28):
    return datetime(2017, 8, day, hour, minute)


LOG = [
    ("TransOeste", 30.0, date(2017, 8, 28), "10:00", at(10, 20)),
    ("TransOeste", 25.0, date(2017, 8, 28), "10:00", at(10, 50)),
    ("TransCarioca", 20.0, date(2017, 8, 28), "11:00", at(11, 30)),
    ("", 5.0, date(2017, 8, 28), "12:00", at(12, 30)),
    ("TransOeste", 99.0, date(2017, 8, 27), "10:00", None),
    ("TransOeste", 88.0, date(2017, 8, 21), "10:00", None),
]


@pytest.fixture(scope="module")
def speed(spark):
    return spark.createDataFrame(LOG, STATS_VEL)


@pytest.fixture(scope="module")
def vehicles(spark):
    return spark.createDataFrame([(c, int(v), d, h, u) for c, v, d, h, u in LOG], STATS_QTD)


def test_by_hour_takes_the_largest_update(speed):
    assert rows(D.speed_by_hour(speed, ANCHOR), "hora", "corredor", "vel_media") == [
        ("10:00", "TransOeste", 30.0),
        ("11:00", "TransCarioca", 20.0),
        ("12:00", "", 5.0),
    ]


def test_by_hour_final_takes_the_last_update(speed):
    got = D.speed_by_hour(speed, ANCHOR, reduce="final")
    assert ("10:00", "TransOeste", 25.0) in rows(got, "hora", "corredor", "vel_media")
    with pytest.raises(ValueError):
        D.speed_by_hour(speed, ANCHOR, reduce="mean")


def test_final_of_rows_without_update_time(speed):
    got = D.speed_by_day(speed, ANCHOR, days=8, reduce="final")
    assert {(r.data.day, r.vel_media) for r in got.filter("corredor = 'TransOeste'").collect()} == {
        (21, 88.0),
        (27, 99.0),
        (28, 25.0),
    }


def test_hour_view_mixes_days_unless_bounded(speed):
    assert ("10:00", "TransOeste", 99.0) in rows(D.speed_by_hour(speed, "2017-08-27"), "hora", "corredor", "vel_media")
    bounded = D.speed_by_hour(speed, "2017-08-27", until=date(2017, 8, 27))
    assert rows(bounded, "hora", "corredor", "vel_media") == [("10:00", "TransOeste", 99.0)]


def test_by_day_excludes_the_boundary_day(speed):
    got = D.speed_by_day(speed, ANCHOR)
    assert rows(got, "label", "corredor", "vel_media") == [
        ("Mon, 2017-8-28", "", 5.0),
        ("Mon, 2017-8-28", "TransCarioca", 20.0),
        ("Mon, 2017-8-28", "TransOeste", 30.0),
        ("Sun, 2017-8-27", "TransOeste", 99.0),
    ]
    assert D.speed_by_day(speed, ANCHOR, days=8).filter("data = date'2017-08-21'").count() == 1


@pytest.mark.parametrize("anchor, kept", [("2017-08-26", True), ("2017-08-27", False)])
def test_vehicle_days_are_six(vehicles, anchor, kept):
    got = D.vehicles_by_day(vehicles, anchor)
    assert (date(2017, 8, 21) in {r.data for r in got.collect()}) is kept


def test_anchor_kinds(speed):
    want = rows(D.speed_by_hour(speed, ANCHOR))
    assert rows(D.speed_by_hour(speed, date(2017, 8, 28))) == want
    assert rows(D.speed_by_hour(speed, datetime(2017, 8, 28))) == want


def hours(stats, measure="vel_media", anchor=ANCHOR):
    return D.chart_rows(stats, measure, anchor, 1)


def test_series_are_aligned(speed):
    got = {r.hora: r for r in D.series(hours(speed), "vel_media", D.HOUR).collect()}
    assert got["10:00"]["TransOeste"] == 30.0 and got["10:00"]["TransCarioca"] is None
    assert got["11:00"]["TransCarioca"] == 20.0
    assert [got["12:00"][c] for c in ("TransCarioca", "TransOeste", "TransOlímpica")] == [None] * 3


def test_series_of_log_rows_equals_series_of_peaks(speed):
    week = D.chart_rows(speed, "vel_media", ANCHOR, 8)
    assert rows(D.series(week, "vel_media", D.DAY)) == rows(D.series(D.peaks(week, "vel_media", D.DAY), "vel_media", D.DAY))


def test_categories_follow_the_day_not_its_label(speed):
    assert [r.category for r in D.categories(hours(speed), D.HOUR).collect()] == ["10:00", "11:00", "12:00"]
    days = [r.category for r in D.categories(D.chart_rows(speed, "vel_media", ANCHOR, 8), D.DAY).collect()]
    assert days == ["Mon, 2017-8-21", "Sun, 2017-8-27", "Mon, 2017-8-28"]


def test_speed_chart_by_hour(speed):
    text = to_json_rows(D.speed_chart(speed, ANCHOR)).first().json
    assert json.loads(text) == {
        "content": [
            {"name": "TransCarioca", "data": [None, 20.0, None]},
            {"name": "TransOeste", "data": [30.0, None, None]},
            {"name": "TransOlímpica", "data": [None, None, None]},
        ],
        "categories": ["10:00", "11:00", "12:00"],
    }


def test_charts_by_day(speed, vehicles):
    payload = json.loads(to_json_rows(D.vehicle_chart(vehicles, ANCHOR, per_day=False)).first().json)
    assert payload["categories"] == ["Sun, 2017-8-27", "Mon, 2017-8-28"]
    assert payload["content"][1] == {"name": "TransOeste", "stack": "BusQuery", "data": [99, 30]}
    assert D.speed_chart(speed, ANCHOR, per_day=False).first().categories == payload["categories"]
    # seven days for speed, six for vehicles
    assert D.speed_chart(speed, "2017-08-27", per_day=False).first().categories[0] == "Mon, 2017-8-21"
    assert D.vehicle_chart(vehicles, "2017-08-27", per_day=False).first().categories[0] == "Sun, 2017-8-27"


def test_empty_log(speed):
    chart = D.speed_chart(speed, "2030-01-01").first()
    assert chart.categories == [] and [s["data"] for s in chart.content] == [[], [], []]
