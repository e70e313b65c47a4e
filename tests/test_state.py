"""Sketches, upsert, archive, late pings, progress reports, database sink."""

import time
from dataclasses import replace
from datetime import date, datetime

import pytest
from helpers import rows, vehicle, write_snapshot
from pyspark.sql import DataFrameReader, DataFrameWriter
from pyspark.sql import functions as F

from fleetlens.operators import sketches
from fleetlens.operators.yearly import metric_extent, metric_rows
from fleetlens.sources import archive as A
from fleetlens.sources import database
from fleetlens.sources import tables as T
from fleetlens.sources.upsert import read_current, upsert_batch
from fleetlens.sources.versions import DayTable
from fleetlens.streaming import ingest, progress, routed

# Sketches


def fleet(spark, vehicles):
    """Every vehicle in three hours of two days, half of them in both corridors."""
    return spark.range(vehicles).selectExpr(
        "CAST(id AS STRING) AS codigo",
        "explode(array(timestamp'2017-08-27 10:00:00Z', timestamp'2017-08-27 11:30:00Z', timestamp'2017-08-28 09:00:00Z')) AS datahora",
        "explode(if(id % 2 = 0, array('a', 'b'), array('a'))) AS corredor",
    )


@pytest.mark.parametrize("lg_k", [8, 12])
def test_sketches_add_up(spark, lg_k):
    own = sketches.window_sketches(fleet(spark, 40_000), lg_k=lg_k)
    assert own.count() == 6 and own.schema["carros"].dataType.typeName() == "binary"
    days = {(r.data.day, r.corredor): r.qtd_carros for r in sketches.vehicles_of(own, "data", "corredor").collect()}
    error = 3 * sketches.relative_error(lg_k)
    for (_, corridor), got in days.items():
        exact = 40_000 if corridor == "a" else 20_000
        assert abs(got - exact) <= error * exact
    whole = {r.level: r.qtd_carros for r in sketches.vehicles_rollup(own, "data", "corredor").collect() if r.level == 0}
    assert abs(whole[0] - 40_000) <= error * 40_000
    # What is there twice counts once.
    twice = sketches.vehicles_of(own.unionByName(own), "corredor").collect()
    assert sorted(twice) == sorted(sketches.vehicles_of(own, "corredor").collect())


def test_sketches_of_different_sizes_and_of_no_vehicle(spark):
    rows_ = fleet(spark, 100)
    both = sketches.window_sketches(rows_, lg_k=12).unionByName(sketches.window_sketches(rows_, lg_k=10))
    assert sketches.vehicles_of(both, "data").count() == 2
    nobody = rows_.withColumn("codigo", F.lit(None).cast("string"))
    assert sketches.window_sketches(nobody).count() == 0
    assert T.route(both) == "stats_sketch"


# Upsert


def stats(spark, *values):
    """(corridor, hour, mean, minute of the update)."""
    return spark.createDataFrame(
        [(c, v, date(2017, 8, 27), h, datetime(2017, 8, 27, 12, m)) for c, h, v, m in values],
        "corredor string, vel_media double, data date, hora string, atualizacao timestamp",
    )


def current(spark, root):
    return rows(read_current(spark, str(root), "stats_vel"), "corredor", "hora", "vel_media")


def test_upsert_keeps_one_row_a_key(spark, tmp_path):
    root = str(tmp_path)
    assert current(spark, root) == []
    assert upsert_batch(stats(spark, ("a", "10:00", 1.0, 0), ("b", "10:00", 2.0, 0)), root, "run", 0)
    second = stats(spark, ("a", "10:00", 5.0, 1), ("a", "11:00", 3.0, 1))
    assert upsert_batch(second, root, "run", 1)
    want = [("a", "10:00", 5.0), ("a", "11:00", 3.0), ("b", "10:00", 2.0)]
    assert current(spark, root) == want
    # A replayed batch changes nothing, nor does an older update of a key.
    assert not upsert_batch(stats(spark, ("a", "10:00", 9.0, 9)), root, "run", 1)
    assert upsert_batch(stats(spark, ("a", "10:00", 7.0, 0)), root, "other", 1)
    assert current(spark, root) == want
    assert upsert_batch(stats(spark).limit(0), root, "run", 2) and not upsert_batch(second, root, "run", 2)
    assert current(spark, root) == want


def test_a_write_that_broke_off_leaves_no_trace(spark, tmp_path):
    root = str(tmp_path)
    upsert_batch(stats(spark, ("a", "10:00", 1.0, 0)), root, "run", 0)
    versions = DayTable(spark, root, "stats_vel")
    # Written, but not in the ledger: the job ended in between.
    versions.write(stats(spark, ("a", "10:00", 8.0, 5), ("z", "10:00", 8.0, 5)), versions.last_version() + 1)
    assert current(spark, root) == [("a", "10:00", 1.0)]
    upsert_batch(stats(spark, ("b", "10:00", 2.0, 0)), root, "run", 1)
    assert current(spark, root) == [("a", "10:00", 1.0), ("b", "10:00", 2.0)]


def test_other_days_are_not_written_again(spark, tmp_path):
    root = str(tmp_path)
    days = stats(spark, ("a", "10:00", 1.0, 0))
    upsert_batch(days, root, "run", 0)
    upsert_batch(days.withColumn("data", F.lit(date(2017, 8, 29))), root, "run", 1)
    written = sorted(p.name for p in (tmp_path / "stats_vel-days" / "version=1").glob("data=*"))
    assert written == ["data=2017-08-29"]
    assert read_current(spark, root, "stats_vel").count() == 2


# Archive


def pings(spark, *days):
    return spark.createDataFrame([("A", datetime(2017, 8, d, 10)) for d in days], "codigo string, datahora timestamp")


def per_day(df):
    return {r.data.day: r["count"] for r in df.groupBy("data").count().collect()}


def test_archives_in_any_order_give_every_row_once(spark, tmp_path):
    root, history = str(tmp_path / "live"), str(tmp_path / "history")
    for _ in range(3):
        T.append(pings(spark, 20, 21, 22, 23), root, "gpsdata")
    day = lambda d: date(2017, 8, d)
    read = lambda: per_day(A.read_archived(spark, root, "gpsdata", history))
    assert read() == {20: 3, 21: 3, 22: 3, 23: 3}
    # A gap, an overlap, the same again, more than before.
    assert A.archive(spark, root, "gpsdata", history, day(22), day(23)) == [day(22)]
    assert A.archive(spark, root, "gpsdata", history, day(1), day(22)) == [day(20), day(21)]
    assert A.archive(spark, root, "gpsdata", history, day(21), day(23)) == []
    assert read() == {20: 3, 21: 3, 22: 3, 23: 3}
    # Rows of archived days that come later count, before and after they are archived.
    T.append(pings(spark, 20, 22), root, "gpsdata")
    assert read() == {20: 4, 21: 3, 22: 4, 23: 3}
    assert A.archive(spark, root, "gpsdata", history, day(20), day(21)) == [day(20)]
    assert read() == {20: 4, 21: 3, 22: 4, 23: 3}
    # Originals go: three files of 21, three of 22, four of 20; the late one of 22 stays.
    assert A.remove_archived(spark, root, "gpsdata", history) == 10
    assert read() == {20: 4, 21: 3, 22: 4, 23: 3}
    assert per_day(T.read_table(spark, root, "gpsdata")) == {22: 1, 23: 3}
    assert A.archive(spark, root, "gpsdata", history, day(1), day(30)) == [day(22), day(23)]
    assert read() == {20: 4, 21: 3, 22: 4, 23: 3}
    both = A.read_archived(spark, root, "gpsdata", history)
    assert both.schema == T.read_table(spark, root, "gpsdata").schema


def test_archive_of_a_streamed_table(spark, tmp_path):
    root, history = str(tmp_path / "live"), str(tmp_path / "history")
    stored = pings(spark, 20, 21).withColumn("data", F.to_date("datahora"))
    stored = stored.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in T.TABLES["gpsdata"] if f.name not in stored.columns])
    stored.write.parquet(str(tmp_path / "in"))
    writer = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "in")).writeStream.format("parquet").partitionBy("data")
    writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(T.sink_path(root, "gpsdata")).awaitTermination()
    T.append(pings(spark, 20), root, "gpsdata")
    A.archive(spark, root, "gpsdata", history, date(2017, 8, 20), date(2017, 8, 21))
    assert per_day(A.read_archived(spark, root, "gpsdata", history)) == {20: 2, 21: 1}


# Late pings


@pytest.fixture
def config(tmp_path):
    folders = [str(tmp_path / n) for n in ("in", "out", "ck")]
    return ingest.IngestConfig(*folders, layout="routed", name_prefix=f"{tmp_path.name}-", max_files=None)


def ping(codigo, when, speed=10.0):
    return vehicle(codigo, "10", "10 - x", speed, f"2017-08-27 {when}")


LANDED = [
    [ping("A", "10:01:00"), ping("A", "10:01:00"), ping("B", "10:30:00", 20.0)],
    [ping("C", "12:30:00", 30.0)],
    # Ten o'clock is closed by now; twelve o'clock is open though 12:05 is before the watermark.
    [ping("D", "10:02:00"), ping("E", "12:05:00", 50.0), ping("C", "12:30:00", 30.0)],
    [],
]


def kept_and_late(spark, config):
    kept = rows(T.read_table(spark, config.out_dir, "gpsdata"), "codigo")
    return [r[0] for r in kept], [r[0] for r in rows(T.read_table(spark, config.out_dir, routed.LATE), "codigo")]


def test_late_pings_are_kept_apart(spark, tmp_path, config):
    for number, records in enumerate(LANDED):
        write_snapshot(tmp_path / "in", f"2017082712{number:02}00", records)
        ingest.run_ingest(spark, config)
    assert kept_and_late(spark, config) == (["A", "B", "C", "E"], ["D"])
    means = rows(read_current(spark, config.out_dir, "stats_vel"), "hora", "vel_media")
    assert means == [("10:00", 15.0), ("12:00", 40.0)]
    count = routed.counts(spark, config).first()
    assert (count.kept, count.late) == (4, 1)


def test_a_replayed_batch_of_routed_pings(spark, tmp_path, config, monkeypatch):
    real, failed = DayTable.commit, []

    def once(self, version, days, run_id=None, batch_id=None, watermark=None):
        # The first batch breaks off after all is written, before it is recorded.
        if self.ledger.endswith("gpsdata-ledger") and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")
        real(self, version, days, run_id, batch_id, watermark)

    monkeypatch.setattr(DayTable, "commit", once)
    write_snapshot(tmp_path / "in", "20170827120000", LANDED[0])
    with pytest.raises(Exception, match="lost"):
        ingest.run_ingest(spark, config)
    for number, records in enumerate(LANDED[1:], 1):
        write_snapshot(tmp_path / "in", f"2017082712{number:02}00", records)
        ingest.run_ingest(spark, config)
    assert failed == [0]
    assert kept_and_late(spark, config) == (["A", "B", "C", "E"], ["D"])
    means = rows(read_current(spark, config.out_dir, "stats_vel"), "hora", "vel_media")
    assert means == [("10:00", 15.0), ("12:00", 40.0)]


def test_limits_of_the_layouts(spark, config):
    for wrong in ({"layout": "x"}, {"jdbc_url": "jdbc:x"}, {"layout": "shared", "stats_max_bytes": 1}):
        with pytest.raises(ValueError):
            ingest.run_ingest(spark, replace(config, **wrong))


def test_limited_statistics_of_the_shared_layout(spark, tmp_path, config):
    shared = replace(config, layout="shared", stats_max_bytes=1, stats_delay="1 day", progress_dir=str(tmp_path / "progress"))
    for number, records in enumerate(LANDED[:2]):
        write_snapshot(tmp_path / "in", f"2017082712{number:02}00", records)
        ingest.run_ingest(spark, replace(shared, layout="shared"))
    log = T.read_table(spark, shared.out_dir, "stats_vel")
    last = {r.hora: r.vel_media for r in log.orderBy("atualizacao").collect()}
    assert last == {"10:00": 15.0, "12:00": 30.0}
    named = {r.name for r in progress.totals(spark, shared.progress_dir).collect()}
    assert named == {shared.name_prefix + n for n in ("positions", "stats")}


# Progress


def test_more_reports_than_a_query_keeps(spark, tmp_path):
    landed, path = tmp_path / "in", str(tmp_path / "progress")
    landed.mkdir()
    for i in range(108):
        (landed / f"{i:03}.json").write_text(f'{{"codigo": "{i}", "datahora": "2017-08-27T10:00:00Z"}}')

    def start():
        source = spark.readStream.schema("codigo string, datahora timestamp").option("maxFilesPerTrigger", 1).json(str(landed))
        kept = source.withWatermark("datahora", "10 minutes").dropDuplicates(["codigo", "datahora"])
        writer = kept.writeStream.queryName(f"many-{tmp_path.name}").foreachBatch(lambda df, _: df.collect())
        return writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    with progress.recording(spark, path, every=25) as log:
        query = start()
        log.finish(query)
    assert len(query.recentProgress) <= 100
    first = progress.totals(spark, path).first()
    assert (first.input_rows, first.dropped_rows, first.state_rows) == (108, 0, 108) and first.batches >= 108
    # After a restart the same query goes on; its late row is counted, too.
    time.sleep(1)
    (landed / "a.json").write_text('{"codigo": "x", "datahora": "2017-08-28T10:00:00Z"}')
    with progress.recording(spark, path) as log:
        log.finish(start())
    (landed / "b.json").write_text('{"codigo": "y", "datahora": "2017-08-27T10:00:00Z"}')
    with progress.recording(spark, path) as log:
        log.finish(start())
    after = progress.totals(spark, path).collect()
    assert len(after) == 1
    assert (after[0].input_rows, after[0].dropped_rows, after[0].state_rows) == (110, 1, 1)


# Database


class Database:
    """Stands for the database: what Spark is handed lands in folders."""

    def __init__(self, spark, root, monkeypatch):
        self.root, self.calls, self.fail = root, [], False

        def read(reader, url, table, properties=None, **_):
            assert url == "jdbc:x" and properties == {"user": "u"}
            return self.table(spark, table)

        def write(writer, url, table, mode=None, properties=None):
            assert (url, mode, properties) == ("jdbc:x", "append", {"user": "u"})
            self.calls.append(table)
            writer.mode("append").parquet(f"{root}/{table}")
            if self.fail and table != database.LEDGER:
                raise RuntimeError("connection lost")

        monkeypatch.setattr(DataFrameReader, "jdbc", read)
        monkeypatch.setattr(DataFrameWriter, "jdbc", write)

    def table(self, spark, name):
        if not (self.root / name).exists():
            return spark.createDataFrame([], database.LEDGER_SCHEMA)
        return spark.read.parquet(f"{self.root}/{name}")


def test_a_batch_is_handed_to_the_database_once(spark, tmp_path, monkeypatch):
    db = Database(spark, tmp_path, monkeypatch)
    write = database.once_writer("jdbc:x", {"user": "u"}, "run")
    write(pings(spark, 20, 21), 0)
    assert db.calls == ["gpsdata", "batch_ledger"]
    write(pings(spark, 20, 21), 0)
    assert db.calls == ["gpsdata", "batch_ledger"]
    # A batch breaks off with its rows written; the next attempt counts, the first does not.
    db.fail = True
    with pytest.raises(RuntimeError):
        write(pings(spark, 22), 1)
    db.fail = False
    write(pings(spark, 22), 1)
    assert db.table(spark, "gpsdata").count() == 4
    counted = database.read_counted(lambda name: db.table(spark, name), "gpsdata")
    assert sorted(r.datahora.day for r in counted.collect()) == [20, 21, 22]
    assert counted.columns == T.TABLES["gpsdata"].fieldNames()


def test_ingest_into_the_database_survives_a_replay(spark, tmp_path, monkeypatch):
    db = Database(spark, tmp_path / "db", monkeypatch)
    folders = [str(tmp_path / n) for n in ("in", "out", "ck")]
    config = ingest.IngestConfig(*folders, layout="independent", jdbc_url="jdbc:x", jdbc_properties={"user": "u"}, name_prefix=f"{tmp_path.name}-")
    write_snapshot(tmp_path / "in", "20170827120000", LANDED[0])
    db.fail = True
    with pytest.raises(Exception, match="connection lost"):
        ingest.finish(ingest.start_positions(spark, config))
    db.fail = False
    ingest.run_ingest(spark, config)
    counted = database.read_counted(lambda name: db.table(spark, name), "gpsdata")
    assert sorted(r.codigo for r in counted.collect()) == ["A", "B"]
    assert db.table(spark, "gpsdata").count() == 4


# Objects of unknown metrics


def test_metrics_nobody_named(spark):
    bodies = [
        '{"2001": {"internet": 1, "new": 2.5, "text": "x", "none": null}, "2002": {"internet": 3}}',
        '{"2003": [7, 8]}',
        "{}",
        "no json",
        None,
        '{"2004": 5}',
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = rows(metric_rows(df, "body", ("id",)))
    assert got == [
        (0, "2001", "internet", 1.0),
        (0, "2001", "new", 2.5),
        (0, "2001", "none", None),
        (0, "2001", "text", None),
        (0, "2002", "internet", 3.0),
        (1, "2003", "0", 7.0),
        (1, "2003", "1", 8.0),
    ]
    extent = {r.metric: (r.first_year.year, r.last_year.year, r.least, r.most) for r in metric_extent(metric_rows(df, "body")).collect()}
    assert extent["internet"] == (2001, 2002, 1.0, 3.0) and extent["text"] == (2001, 2001, None, None)
