"""Snapshots to positions: schema, cleaning, dedupe."""

import unicodedata

import pytest
from helpers import ms, plan_of, rows, times_as_text, vehicle, write_snapshot
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.functions.vehicle import corridor_of_line, event_time, line_of_route, mean, parse_float
from fleetlens.operators.positions import clean, clean_snapshots, dedupe
from fleetlens.schemas import GPSDATA, SNAPSHOT
from fleetlens.sources.snapshots import read_snapshots, with_snapshot_time

CASES = [
    vehicle("A", "50", "50 - x", 40.0),
    vehicle("B", "5012345", "10-y", 20.0),
    vehicle("B", "5012345", "10-y", 20.0),
    vehicle("C", "20A", "20A - z", 30.0),
    vehicle("D", "123", "22 - no", 30.0),
    vehicle("E", "22", None, None),
    vehicle("F", "22", "expresso - x", 10.0),
    vehicle("G", "99", "99 - q", 10.0),
    vehicle("H", "33", "33 - q", 0.0),
    vehicle("I", "501234", "10-y", 20.0),
    vehicle("J", None, "10 - y", 20.0),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("snapshots")
    write_snapshot(folder, "20170827100000", CASES)
    write_snapshot(folder, "20170827100100", [])
    write_snapshot(folder, "20170827100200", None, raw='{"veiculos": null}')
    write_snapshot(folder, "20170827100300", None, raw='{"other": 1}')
    write_snapshot(folder, "20170827100400", None, raw='{"veiculos": [{"codigo": "bro')
    return folder


def test_cleaning_cases(spark, folder):
    got = clean_snapshots(read_snapshots(spark, str(folder)))
    assert got.columns == GPSDATA.fieldNames()
    assert rows(got, "codigo", "linha", "corredor", "velocidade") == [
        ("A", "50", "TransOlímpica", 40.0),
        ("C", "20A", "TransOeste", 30.0),
        ("G", "99", "", 10.0),
        ("H", "33", "TransCarioca", 0.0),
        ("I", "10", "TransOeste", 20.0),
    ]
    times = {r.datahora for r in times_as_text(got, "datahora").collect()}
    assert times == {"2017-08-27 10:00:00"}


def test_older_snapshots_without_newer_fields(spark, tmp_path):
    raw = '{"veiculos": [{"codigo": "K", "linha": "10", "datahora": 1503828000789, "velocidade": 3}]}'
    write_snapshot(tmp_path, "20170817182501", None, raw=raw)
    docs = read_snapshots(spark, str(tmp_path))
    assert docs.schema == SNAPSHOT
    record = docs.select(F.explode("veiculos").alias("v")).select("v.*").first()
    assert (record.trajeto, record.sentido, record.datahora) == (None, None, 1503828000789.0)
    assert clean_snapshots(docs).count() == 0  # no route, no line


def test_no_time_no_position(spark, tmp_path):
    write_snapshot(tmp_path, "20170827100000", [vehicle("A", "50", "50 - x", datahora=None), vehicle("Z", "50", "50 - x")])
    assert rows(clean_snapshots(read_snapshots(spark, str(tmp_path))), "codigo") == [("Z",)]


def test_unused_field_is_not_read(spark, folder):
    plan = plan_of(clean_snapshots(read_snapshots(spark, str(folder))))
    assert "id_migracao" not in plan


def test_snapshot_time_from_name(spark, folder):
    docs = with_snapshot_time(read_snapshots(spark, str(folder)))
    stamps = {r.snapshot_ts for r in times_as_text(docs, "snapshot_ts").collect()}
    assert "2017-08-27 10:00:00" in stamps and len(stamps) == 5
    odd = with_snapshot_time(read_snapshots(spark, str(folder)), pattern=r"nothing_(\d{14})")
    assert {r.snapshot_ts for r in odd.collect()} == {None}


@pytest.mark.parametrize(
    "epoch, expected",
    [(1503828000789.0, 1503828000), (0.0, 0), (999.9, 0), (1000.0, 1), (None, None)],
)
def test_event_time_is_cut_to_seconds(spark, epoch, expected):
    df = spark.createDataFrame([(epoch,)], "t double").select(F.unix_seconds(event_time(F.col("t"))).alias("s"))
    assert df.first().s == expected


def test_line_and_corridor(spark):
    routes = ["50 - x", " 20A -y", "expresso", "", "1-", "-x", "34-a-b", "60 - z"]
    df = spark.createDataFrame([(r,) for r in routes], "trajeto string")
    df = df.withColumn("linha", line_of_route("trajeto")).withColumn("c", corridor_of_line("linha"))
    assert [(r.linha, r.c) for r in df.collect()] == [
        ("50", "TransOlímpica"),
        ("20A", "TransOeste"),
        ("expresso", ""),
        ("", ""),
        ("1", "TransOeste"),
        ("", ""),
        ("34", "TransCarioca"),
        ("60", ""),
    ]


def test_accented_name_is_composed():
    assert unicodedata.is_normalized("NFC", C.TRANS_OLIMPICA)


def test_parse_float_reads_a_leading_number(spark):
    texts = ["-22.98", " 1.5 graus", "3e2x", ".5", "5.", "+7", "", "x1", None, "-", "1-2"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_float(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == [-22.98, 1.5, 300.0, 0.5, 5.0, 7.0, None, None, None, None, 1.0]


def test_exact_mean_does_not_depend_on_order(spark):
    values = [(i, round(0.01 * (i * 7919 % 50000), 2)) for i in range(5000)]
    df = spark.createDataFrame(values, "i int, v double")
    means = {
        df.repartition(n, "i").agg(mean(F.col("v"), exact_scale=2).alias("m")).first().m for n in (1, 3, 8)
    }
    assert len(means) == 1
    assert df.filter("i < 0").agg(mean(F.col("v"), exact_scale=2).alias("m")).first().m is None


def positions(spark, data):
    df = spark.createDataFrame(data, "codigo string, t string, linha string, velocidade double")
    return df.withColumn("datahora", F.to_timestamp("t")).drop("t")


def test_dedupe_keeps_one_and_is_idempotent(spark):
    data = [
        ("A", "2017-08-27 10:00:00", "10", 5.0),
        ("A", "2017-08-27 10:00:00", "10", 3.0),
        ("A", "2017-08-27 10:00:01", "10", 4.0),
        ("B", "2017-08-27 10:00:00", None, None),
        ("B", "2017-08-27 10:00:00", "22", 1.0),
    ]
    once = dedupe(positions(spark, data))
    expected = [("A", "10", 3.0), ("A", "10", 4.0), ("B", None, None)]
    assert rows(once, "codigo", "linha", "velocidade") == expected
    assert rows(dedupe(once), "codigo", "linha", "velocidade") == expected
    assert rows(dedupe(positions(spark, data[::-1]).repartition(3)), "codigo", "linha", "velocidade") == expected


def test_trailing_columns_do_not_change_the_pick(spark):
    from itertools import product

    cells = product("AB", (None, "", "TransOeste"), (None, 1.0, 2.0), ("10", "20"), ("ida", "volta"))
    df = spark.createDataFrame(
        list(cells), "codigo string, corredor string, velocidade double, linha string, sentido string"
    ).withColumn("datahora", F.timestamp_seconds(F.abs(F.hash("corredor", "velocidade", "linha", "sentido")) % 5))
    keep = ["codigo", "datahora", "corredor", "velocidade"]
    assert rows(dedupe(df), *keep) == rows(dedupe(df.select(*keep)), *keep)


def test_dedupe_collapses_copies_before_the_shuffle(spark):
    copies = spark.range(30000).select(
        F.lit("A").alias("codigo"), F.timestamp_seconds(F.lit(1503828000)).alias("datahora"), F.lit(1.0).alias("velocidade")
    )
    assert dedupe(copies).count() == 1
    plan = plan_of(dedupe(copies))
    assert plan.index("partial_min") > plan.index("Exchange")  # below the exchange in the printed tree


def test_millisecond_helper():
    assert ms("1970-01-01 00:00:01", 5) == 1005


def test_cleaning_against_plain_rules(spark):
    import random
    import re

    rng = random.Random(11)

    def text(alphabet, longest):
        if rng.random() < 0.05:
            return None
        return "".join(rng.choice(alphabet) for _ in range(rng.randrange(longest + 1)))

    data = [(i, text("5A12 ç", 7), text("1235A -", 8)) for i in range(4000)]

    def expected(code, route):
        if code is None or route is None:
            return None
        if not (re.fullmatch("5.{5}", code) or re.fullmatch("..A", code) or re.fullmatch("..", code)):
            return None
        line = route.split("-")[0].strip(" ")
        if len(line) not in (2, 3):
            return None
        corridor = {"1": "TransOeste", "2": "TransOeste", "3": "TransCarioca", "5": "TransOlímpica"}.get(line[0], "")
        return line, corridor

    records = spark.createDataFrame(data, "n int, codlinha string, trajeto string").selectExpr(
        "CAST(n AS STRING) AS codigo", "codlinha", "trajeto", "TIMESTAMP '2017-08-27 10:00:00' AS datahora",
        "0D AS latitude", "0D AS longitude", "0D AS velocidade", "'' AS sentido",
    )
    got = {int(r.codigo): (r.linha, r.corredor) for r in clean(records).collect()}
    want = {n: e for n, code, route in data if (e := expected(code, route)) is not None}
    assert got == want and len(want) > 100
