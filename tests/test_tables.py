"""Tables: routing, append by name, replays, catalog, pruning."""

from datetime import date, datetime

import pytest
from helpers import plan_of, rows
from pyspark.sql import functions as F

from fleetlens.functions.vehicle import event_time
from fleetlens.operators.recent import recent_positions
from fleetlens.schemas import STATS_VEL, TABLES, align, append_to_catalog, create_tables, stored_schema, with_partition_day
from fleetlens.session import scoped_conf, scratch_dir, shuffle_conf
from fleetlens.sources import tables as T
from fleetlens.sources.paths import spread


@pytest.fixture(scope="module")
def gps(spark):
    data = [("A", datetime(2017, 8, 27, 10), 1.0, "TransOeste"), ("B", datetime(2017, 8, 28, 10), None, "")]
    return spark.createDataFrame(data, "codigo string, datahora timestamp, velocidade double, corredor string")


def test_routing_by_columns(spark, gps):
    assert T.route(gps) == "gpsdata"
    assert T.route(gps.withColumn("vel_media", F.lit(1.0))) == "stats_vel"
    assert T.route(gps.withColumn("qtd_carros", F.lit(1))) == "stats_qtd"
    assert T.route(gps.withColumn("vel_media", F.lit(1.0)).withColumn("qtd_carros", F.lit(1))) == "stats_vel"


def test_append_by_name_with_real_nulls(spark, gps, tmp_path):
    root = str(tmp_path)
    T.append(gps.select("corredor", "velocidade", "datahora", "codigo"), root)
    T.append(gps, root)
    back = T.read_table(spark, root, "gpsdata")
    assert back.columns == stored_schema("gpsdata").fieldNames()
    assert rows(back, "codigo", "velocidade", "linha", "data") == [
        ("A", 1.0, None, date(2017, 8, 27)),
        ("A", 1.0, None, date(2017, 8, 27)),
        ("B", None, None, date(2017, 8, 28)),
        ("B", None, None, date(2017, 8, 28)),
    ]


def test_a_replayed_batch_replaces_itself(spark, gps, tmp_path):
    root = str(tmp_path)
    write = T.batch_writer(root, "run")
    write(gps, 0)
    write(gps, 1)
    write(gps.filter("codigo = 'A'"), 1)
    assert rows(T.read_table(spark, root, "gpsdata", ("batch_id",)), "batch_id", "codigo") == [(0, "A"), (0, "B"), (1, "A")]
    T.batch_writer(root, "another run")(gps, 0)
    assert T.read_table(spark, root, "gpsdata").count() == 5


def test_day_filter_prunes_folders(spark, gps, tmp_path):
    T.append(gps, str(tmp_path))
    got = T.read_table(spark, str(tmp_path), "gpsdata").filter("data > date'2017-08-27'")
    assert "data#" in plan_of(got).split("PartitionFilters")[1].split("]")[0]
    assert [r.codigo for r in got.collect()] == ["B"]


def test_a_large_day_is_cut_with_aqe(spark, tmp_path):
    copies = spark.range(0, 40000, 1, 8).select(
        F.lit("A").alias("codigo"), F.timestamp_seconds(F.lit(1503828000)).alias("datahora")
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "1000")
    try:
        T.write_batch(copies, str(tmp_path / "cut"), run_id="r")
    finally:
        spark.conf.unset(key)
    T.write_batch(copies, str(tmp_path / "joined"), run_id="r")
    files = {name: len(list((tmp_path / name).rglob("*.parquet"))) for name in ("cut", "joined")}
    assert files["cut"] > 1 and files["joined"] == 1
    assert T.read_table(spark, str(tmp_path / "cut"), "gpsdata").count() == 40000


def test_rows_stay_in_place_without_aqe(spark, gps, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Exchange" not in plan_of(spread(gps.withColumn("data", F.to_date("datahora")), "data"))
        T.append(gps, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert T.read_table(spark, str(tmp_path), "gpsdata").count() == 2


def test_catalog_tables(spark, gps):
    spark.sql("CREATE DATABASE IF NOT EXISTS fleet")
    create_tables(spark, "fleet")
    create_tables(spark, "fleet")
    assert {t.name for t in spark.catalog.listTables("fleet")} == set(TABLES)
    append_to_catalog(gps, "gpsdata", "fleet")
    append_to_catalog(gps.select("datahora", "codigo"), "gpsdata", "fleet")
    stored = spark.table("fleet.gpsdata")
    assert stored.columns == stored_schema("gpsdata").fieldNames()
    assert rows(stored, "codigo", "corredor") == [("A", "TransOeste"), ("A", None), ("B", ""), ("B", None)]
    log = spark.createDataFrame([("TransOeste", 1.0, date(2017, 8, 28), "10:00", None)], STATS_VEL)
    append_to_catalog(log, "stats_vel", "fleet")
    assert spark.table("fleet.stats_vel").first().hora == "10:00"
    spark.sql("DROP DATABASE fleet CASCADE")


def test_json_rows_write_nulls(gps):
    text = [r.json for r in T.to_json_rows(gps.select("codigo", "velocidade")).orderBy("json").collect()]
    assert text == ['{"codigo":"A","velocidade":1.0}', '{"codigo":"B","velocidade":null}']


def test_preview_prints(gps, capfd):
    T.preview(gps.select("codigo"), 1)
    assert "codigo" in capfd.readouterr().out


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert one.startswith(base) and one != two


def test_scratch_without_the_setting(spark, monkeypatch):
    class Bare:
        def __init__(self, master):
            self.conf = self
            self.sparkContext = type("Context", (), {"master": master})

        def get(self, key, default=None):
            return default

    local = scratch_dir(Bare("local[2]"), "x")
    assert "/fleetlens/x-" in local
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Bare("yarn"), "x")


def test_scoped_conf_leaves_user_settings(spark):
    key, other = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    with scoped_conf(spark, {key: "x", other: "77"}):
        assert spark.conf.get(key) == "x"
        assert spark.conf.get(other) == "4"
    assert spark.conf.get(key, None) is None


def test_jdbc_gets_the_tables_own_columns(gps, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    calls = []

    def jdbc(self, url, table, mode=None, properties=None):
        calls.append((url, table, mode, properties, self._df.columns))

    monkeypatch.setattr(DataFrameWriter, "jdbc", jdbc)
    T.jdbc_writer("jdbc:x", {"user": "u"})(gps, 3)
    assert calls == [("jdbc:x", "gpsdata", "append", {"user": "u"}, TABLES["gpsdata"].fieldNames())]


def test_preview_of_a_stream(spark, gps, tmp_path):
    gps.write.parquet(str(tmp_path / "in"))
    query = T.preview_stream(spark.readStream.schema(gps.schema).parquet(str(tmp_path / "in")), mode="append")
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None
    assert sum(p["numInputRows"] for p in query.recentProgress) == 2


@pytest.mark.parametrize(
    "size, partitions", [(0, 1), (1, 1), (256 * 2**20, 1), (10 * 2**40, 40960), (100 * 2**40, 409600)]
)
def test_shuffles_start_with_enough_partitions(size, partitions):
    conf = shuffle_conf(size)
    assert conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == str(partitions)


def test_layouts_do_not_hide_rows(spark, gps, tmp_path):
    root = str(tmp_path)
    T.append(gps, root)
    stored = align(with_partition_day(gps), stored_schema("gpsdata"))
    stored.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in"))
    writer = source.writeStream.format("parquet").partitionBy("data").option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start(T.sink_path(root, "gpsdata")).awaitTermination()
    assert T.read_table(spark, root, "gpsdata").count() == 2 * gps.count()
    T.append(gps, root)
    assert T.read_table(spark, root, "gpsdata").count() == 3 * gps.count()


def test_days_do_not_depend_on_the_session_zone(spark, tmp_path):
    df = spark.sql("SELECT 'A' AS codigo, timestamp'2017-08-28 00:58:00Z' AS datahora")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        T.append(df, str(tmp_path), "gpsdata")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        got = recent_positions(T.read_table(spark, str(tmp_path), "gpsdata"), "2017-08-28 01:00:00")
        assert got.count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_absurd_times_are_null(spark):
    df = spark.sql("SELECT explode(array(1e30D, 1e16D, -1e18D, double('NaN'), null, 1503828000789D)) AS ms")
    got = [r.t for r in df.select(event_time(F.col("ms")).cast("long").alias("t")).collect()]
    assert got == [None, None, None, None, None, 1503828000]
