"""Stations, line groups, icons, itineraries, yearly objects."""

import json
from datetime import date

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators import dimensions as D
from fleetlens.operators import yearly as Y
from fleetlens.schemas import ITINERARY, STATION
from fleetlens.sources import stations as S


def station(name, latitude="-22.98", longitude="-43.36", **more):
    record = {f: "" for f in STATION.fieldNames()}
    return {**record, "estacao": name, "latitude": latitude, "longitude": longitude, **more}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("stations")
    sources = {
        "a": (json.dumps([station("Um", numero="12"), station("Dois", numero="")], indent=1, ensure_ascii=False), "\n"),
        "b": (json.dumps([station("Três", horarioestacao="05h à 01h")], indent=1, ensure_ascii=False), "\r\n"),
        "c": (json.dumps([station("Um", latitude="sem dado"), station("Dez", longitude=None)], indent=1), "\n"),
    }
    for name, (text, newline) in sources.items():
        (folder / f"{name}.json").write_bytes(text.replace("\n", newline).encode("utf-8"))
    return folder


def sources(spark, files):
    return {name: S.read_stations(spark, str(files / f"{name}.json")) for name in "abc"}


def test_station_union_keeps_every_row(spark, files):
    union = S.union_stations(sources(spark, files))
    assert rows(union, "source", "estacao") == [("a", "Dois"), ("a", "Um"), ("b", "Três"), ("c", "Dez"), ("c", "Um")]
    assert union.filter("estacao = 'Três'").first().horarioestacao == "05h à 01h"
    together = S.read_stations(spark, [str(files / f"{n}.json") for n in "abc"])
    assert together.count() == 5


def test_station_coordinates_and_markers(spark, files):
    union = S.union_stations(sources(spark, files))
    located = {(r.source, r.estacao): (r.latitude, r.longitude) for r in S.with_coordinates(union).collect()}
    assert located[("a", "Um")] == (-22.98, -43.36)
    assert located[("c", "Um")] == (None, -43.36)
    assert located[("c", "Dez")] == (-22.98, None)
    marker = S.station_markers(union).filter("title = 'Três'").first()
    assert (marker.position.lat, marker.position.lng, marker.icon) == (-22.98, -43.36, "/static/estacao.png")


LINES = [("10", 1), ("41", 2), ("20A", 3), ("21A", 4), ("99", 5), ("18", 6), (None, 7), ("41", 8)]


@pytest.fixture(scope="module")
def positions(spark):
    return spark.createDataFrame(LINES, "linha string, n int")


def test_lines_in_two_groups_are_tagged_twice(positions):
    assert rows(D.tag_groups(positions), "n", "grupo") == [
        (1, "transoeste"),
        (2, "transcarioca"),
        (2, "transolimpica"),
        (3, "transoeste"),
        (6, "lote_zero"),
        (6, "transoeste"),
        (8, "transcarioca"),
        (8, "transolimpica"),
    ]


def test_membership_keeps_each_position_once(positions):
    assert rows(D.in_groups(positions, "transcarioca", "transolimpica"), "n") == [(2,), (8,)]
    assert rows(D.in_groups(positions), "n") == []


def test_flat_list_differs_from_the_groups(positions):
    assert rows(D.in_all_lines(positions), "n") == [(1,), (2,), (4,), (6,), (8,)]
    grouped = {line for lines in C.LINE_GROUPS.values() for line in lines}
    assert grouped - set(C.ALL_LINES) == {"20A"} and set(C.ALL_LINES) - grouped == {"21A"}


def test_icons_by_lookup(spark):
    df = spark.createDataFrame([("TransOeste",), ("",), (None,), ("TransOlímpica",)], "corredor string")
    assert dict(rows(D.with_icon(df), "corredor", "icon")) == {
        "TransOeste": "../static/transoeste.png",
        "TransOlímpica": "../static/transolimpica.png",
        "": None,
        None: None,
    }


def test_itinerary_with_stations(spark, files):
    stops = spark.createDataFrame(
        [(10, "ida", "10 - x", "Dois", 1, "Um"), (10, "ida", "10 - x", "Dois", 2, "Nenhuma")], ITINERARY
    )
    places = S.with_coordinates(S.read_stations(spark, str(files / "a.json")))
    got = D.itinerary_stations(stops, places)
    assert rows(got, "sequencia", "estacao", "latitude") == [(1, "Um", -22.98), (2, "Nenhuma", None)]


YEARS = [("Brazil", '{"1998": [1.5, 0.7], "1999": [2.5]}'), ("Chile", '{"2001": [null, 0.9], "x": [9, 9]}'), ("Peru", "{}")]


def test_year_rows_extent_and_range(spark):
    objects = spark.createDataFrame(YEARS, "country string, body string")
    got = Y.year_rows(objects, "body", ("country",))
    assert rows(got, "country", "year", "internet", "human") == [
        ("Brazil", "1998", 1.5, 0.7),
        ("Brazil", "1999", 2.5, None),
        ("Chile", "2001", None, 0.9),
        ("Chile", "x", 9.0, 9.0),
    ]
    assert Y.year_extent(got).first()[:] == (date(1998, 1, 1), date(2001, 1, 1), 9.0, 0.7, 9.0)
    assert rows(Y.year_range(got, "Brazil", 1999, 2015, ("internet",))) == [("Brazil", "1999", 2.5)]
    assert Y.year_range(got, "Chile", 1990, 2015, ("human",)).count() == 1


def test_dimensions_are_literals(spark):
    assert D.line_groups(spark).count() == sum(len(v) for v in C.LINE_GROUPS.values())
    assert D.corridor_icons(spark).select(F.count_distinct("corredor")).first()[0] == 3
