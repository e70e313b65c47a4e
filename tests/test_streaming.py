"""Watermark, dedupe, update log, restart, layouts, replay."""

import json
import os
import time
from dataclasses import replace

import pytest
from helpers import rows, times_as_text, vehicle, write_snapshot
from pyspark.sql import functions as F

from fleetlens.operators.dashboards import last_update
from fleetlens.operators.positions import clean_snapshots, dedupe, dedupe_stream
from fleetlens.operators.stats import combined_stats, window_speed, window_vehicles
from fleetlens.schemas import TABLES
from fleetlens.sources import database
from fleetlens.sources.snapshots import read_snapshots, stream_snapshots
from fleetlens.sources.tables import read_table
from fleetlens.streaming import ingest
from fleetlens.streaming.extrema import added_points, running_extrema
from fleetlens.streaming.replay import time_cuts

# (codigo, time, value) per landed file.
FIVE_RUNS = [
    [("A", "10:01", 10), ("A", "10:01", 10), ("B", "10:30", 20)],
    [("C", "12:30", 30), ("D", "10:02", 40)],
    [("E", "10:03", 50), ("F", "12:25", 60), ("C", "12:30", 30)],
    [("G", "15:00", 1)],
    [("H", "10:05", 1)],
]

SCHEMA = "codigo string, datahora timestamp, v double"


def land(folder, number, records):
    folder.mkdir(parents=True, exist_ok=True)
    lines = [json.dumps({"codigo": c, "datahora": f"2017-08-27T{t}:00Z", "v": v}) for c, t, v in records]
    (folder / f"part_{number}.json").write_text("\n".join(lines))


class Probe:
    """Collects what each micro-batch of a query emits."""

    def __init__(self, spark, folder, checkpoint, shape, mode, files=None):
        self.spark, self.folder, self.checkpoint = spark, folder, checkpoint
        self.shape, self.mode, self.files = shape, mode, files
        self.batches = []

    def run(self):
        source = self.spark.readStream.schema(SCHEMA)
        if self.files:
            source = source.option("maxFilesPerTrigger", self.files)
        out = self.shape(source.json(str(self.folder)))
        query = (
            out.writeStream.outputMode(self.mode)
            .option("checkpointLocation", str(self.checkpoint))
            .foreachBatch(lambda df, _: self.batches.append(rows(df)))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query

    def take(self):
        emitted, self.batches = sorted(r for b in self.batches for r in b), []
        return emitted


def hourly(salt):
    def shape(raw):
        unique = dedupe_stream(raw, salt_buckets=salt)
        groups = unique.groupBy(F.window("datahora", "1 hour")).agg(F.avg("v").alias("m"), F.count("*").alias("n"))
        return groups.select(F.date_format("window.start", "HH").alias("h"), F.round("m", 2).alias("m"), "n")

    return shape


@pytest.mark.parametrize("salt", [1, 4])
@pytest.mark.parametrize(
    "mode, expected",
    [
        ("update", [[("10", 15.0, 2)], [("12", 30.0, 1)], [("12", 45.0, 2)], [("15", 1.0, 1)], []]),
        ("append", [[], [("10", 15.0, 2)], [], [("12", 45.0, 2)], []]),
    ],
)
def test_late_rows_duplicates_and_restarts(spark, tmp_path, salt, mode, expected):
    probe = Probe(spark, tmp_path / "in", tmp_path / "ck", hourly(salt), mode)
    dropped = []
    got = []
    for number, records in enumerate(FIVE_RUNS):
        land(tmp_path / "in", number, records)
        query = probe.run()  # each run restarts the query from its checkpoint
        got.append(probe.take())
        dropped.append(ingest.late_rows(query))
    assert got == expected
    assert dropped == [0, 1, 1, 0, 1]


BACK_TO_BACK = [
    [("A", "10:30", 10)],
    [("C", "12:30", 30), ("D", "10:02", 40)],
    [("E", "10:03", 50), ("E2", "12:21", 5)],
    [("H", "10:05", 1)],
]


@pytest.mark.parametrize("salt", [1, 4])
def test_late_limit_lags_one_batch(spark, tmp_path, salt):
    def shape(raw):
        return dedupe_stream(raw, salt_buckets=salt).select("codigo")

    for number, records in enumerate(BACK_TO_BACK):
        land(tmp_path / "in", number, records)
        os.utime(tmp_path / "in" / f"part_{number}.json", (1503828000 + number, 1503828000 + number))
    probe = Probe(spark, tmp_path / "in", tmp_path / "ck", shape, "update", files=1)
    probe.run()
    assert [b for b in probe.batches if b] == [[("A",)], [("C",), ("D",)], [("E2",)]]


def test_many_copies_of_one_ping(spark, tmp_path):
    copies = spark.range(0, 9000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("codigo"),
        F.lit("2017-08-27T10:00:00Z").alias("datahora"),
        F.lit(1.0).alias("v"),
    )
    copies.write.json(str(tmp_path / "in"))
    passed = {}
    for salt in (1, 3):
        probe = Probe(spark, tmp_path / "in", tmp_path / f"ck{salt}", lambda raw: dedupe_stream(raw, salt_buckets=salt).select("codigo"), "update")
        query = probe.run()
        assert len(probe.take()) == 6001
        first = next(p for p in query.recentProgress if p["numInputRows"])
        passed[salt] = [s["numRowsTotal"] for s in first["stateOperators"]]
    assert passed[1] == [6001]
    # the second dedupe sees at most one copy per salt
    assert passed[3][0] == 6001 and 6001 <= passed[3][1] <= 6003


def fleet_files(folder):
    """Three landed snapshots: an hour changes twice, one ping comes twice, one late."""
    write_snapshot(
        folder / "one",
        "20170827101000",
        [
            vehicle("A", "10", "10 - x", 10.0, "2017-08-27 10:05:00"),
            vehicle("A", "10", "10 - x", 10.0, "2017-08-27 10:05:00"),
            vehicle("B", "33", "33 - x", 0.0, "2017-08-27 10:06:00"),
            vehicle("C", "99", "99 - x", 7.0, "2017-08-27 10:06:00"),
        ],
    )
    write_snapshot(
        folder / "two",
        "20170827105000",
        [
            vehicle("A", "10", "10 - x", 10.0, "2017-08-27 10:05:00"),
            vehicle("D", "20", "20 - x", 5.0, "2017-08-27 10:50:00"),
            vehicle("Z", "5012345", "10 - x", 5.0, "2017-08-27 10:50:00"),
        ],
    )
    write_snapshot(
        folder / "three",
        "20170827121000",
        [
            vehicle("E", "10", "10 - x", 1.0, "2017-08-27 10:20:00"),
            vehicle("A", "10", "10 - x", 9.0, "2017-08-27 12:10:00"),
        ],
    )
    return ["one", "two", "three"]


def land_file(source, landing):
    landing.mkdir(parents=True, exist_ok=True)
    for path in source.iterdir():
        (landing / path.name).write_bytes(path.read_bytes())


def config(tmp_path, **more):
    return ingest.IngestConfig(
        str(tmp_path / "landing"), str(tmp_path / "tables"), str(tmp_path / "checkpoints"), salt_buckets=2, **more
    )


SPEED_LOG = [
    ("10:00", "", 7.0),
    ("10:00", "TransOeste", 10.0),
    ("10:00", "TransOeste", 7.5),
    ("12:00", "TransOeste", 9.0),
]


@pytest.mark.parametrize("layout", ["shared", "independent"])
def test_ingest_writes_the_three_tables(spark, tmp_path, layout):
    job = config(tmp_path, layout=layout, files_per_batch=1)
    for name in fleet_files(tmp_path / "files"):
        land_file(tmp_path / "files" / name, tmp_path / "landing")
        ingest.run_ingest(spark, job)
    ingest.run_ingest(spark, job)  # nothing new: nothing is added
    gps = times_as_text(read_table(spark, job.out_dir, "gpsdata"), "datahora")
    assert rows(gps, "codigo", "datahora", "corredor", "velocidade") == [
        ("A", "2017-08-27 10:05:00", "TransOeste", 10.0),
        ("A", "2017-08-27 12:10:00", "TransOeste", 9.0),
        ("B", "2017-08-27 10:06:00", "TransCarioca", 0.0),
        ("C", "2017-08-27 10:06:00", "", 7.0),
        ("D", "2017-08-27 10:50:00", "TransOeste", 5.0),
    ]
    speed = read_table(spark, job.out_dir, "stats_vel")
    assert rows(speed, "hora", "corredor", "vel_media") == SPEED_LOG
    final = rows(last_update(speed, "vel_media"), "hora", "corredor", "vel_media")
    assert final == [SPEED_LOG[0], SPEED_LOG[2], SPEED_LOG[3]]
    vehicles = rows(last_update(read_table(spark, job.out_dir, "stats_qtd"), "qtd_carros"), "hora", "corredor", "qtd_carros")
    assert vehicles == [("10:00", "", 1), ("10:00", "TransCarioca", 1), ("10:00", "TransOeste", 2), ("12:00", "TransOeste", 1)]


def test_stream_equals_batch(spark, tmp_path):
    names = fleet_files(tmp_path / "files")[:2]  # without the late ping
    job = config(tmp_path)
    for name in names:
        land_file(tmp_path / "files" / name, tmp_path / "landing")
        ingest.run_ingest(spark, job)
    unique = dedupe(clean_snapshots(read_snapshots(spark, job.files_dir)))
    speed = window_speed(unique, "1 hour", positive_only=True)
    streamed = last_update(read_table(spark, job.out_dir, "stats_vel"), "vel_media")
    columns = ("data", "hora", "corredor", "vel_media")
    assert rows(streamed, *columns) == rows(speed, *columns)
    vehicles = window_vehicles(unique, "1 hour", positive_only=True)
    streamed = last_update(read_table(spark, job.out_dir, "stats_qtd"), "qtd_carros")
    columns = ("data", "hora", "corredor", "qtd_carros")
    assert rows(streamed, *columns) == rows(vehicles, *columns)


def test_a_failed_batch_is_replayed_once(spark, tmp_path, monkeypatch):
    fleet_files(tmp_path / "files")
    land_file(tmp_path / "files" / "one", tmp_path / "landing")
    job = config(tmp_path, layout="independent")
    true_write = ingest.write_batch

    def write_then_fail(*args, **kwargs):
        true_write(*args, **kwargs)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(ingest, "write_batch", write_then_fail)
    with pytest.raises(Exception, match="lost after the write"):
        ingest.finish(ingest.start_positions(spark, job))
    assert read_table(spark, job.out_dir, "gpsdata").count() == 3
    monkeypatch.setattr(ingest, "write_batch", true_write)
    ingest.finish(ingest.start_positions(spark, job))
    assert read_table(spark, job.out_dir, "gpsdata").count() == 3


def test_a_fresh_checkpoint_never_replaces_rows(spark, tmp_path):
    fleet_files(tmp_path / "files")
    land_file(tmp_path / "files" / "one", tmp_path / "landing")
    job = config(tmp_path, layout="independent")
    ingest.finish(ingest.start_positions(spark, job))
    ingest.finish(ingest.start_positions(spark, replace(job, checkpoint_dir=str(tmp_path / "other"))))
    assert read_table(spark, job.out_dir, "gpsdata").count() == 6


def test_running_queries_and_failure(spark, tmp_path):
    fleet_files(tmp_path / "files")
    land_file(tmp_path / "files" / "one", tmp_path / "landing")
    job = config(tmp_path, trigger="1 second")
    queries = ingest.run_ingest(spark, job)
    try:
        assert [q.name for q in queries] == ["positions", "stats"]
        for query in queries:
            query.processAllAvailable()
        assert read_table(spark, job.out_dir, "gpsdata").count() == 3
        (tmp_path / "landing" / "x.json").write_text("{}")
    finally:
        for query in queries:
            query.stop()
    ingest.wait_all(spark)
    with pytest.raises(ValueError):
        ingest.run_ingest(spark, replace(job, layout="other"))


def test_planned_triggers_per_query(spark, tmp_path):
    fleet_files(tmp_path / "files")
    land_file(tmp_path / "files" / "one", tmp_path / "landing")
    job = config(tmp_path, layout="independent", trigger=ingest.PLANNED_TRIGGERS)
    queries = ingest.run_ingest(spark, job)
    try:
        assert [q.name for q in queries] == ["positions", "speed", "vehicles"]
        # The first batch runs at once; the next is an interval away.
        deadline = time.time() + 60
        while time.time() < deadline and not all(q.lastProgress for q in queries):
            time.sleep(0.5)
        assert [q.lastProgress["numInputRows"] for q in queries] == [1, 1, 1]
        assert read_table(spark, job.out_dir, "stats_qtd").count() == 3
    finally:
        for query in queries:
            query.stop()


def test_rate_limits(spark, tmp_path):
    for number in range(5):
        write_snapshot(tmp_path / "in", f"2017082710000{number}", [vehicle("A", "10", "10 - x", when=f"2017-08-27 10:00:0{number}")])

    def inputs(**limit):
        stream = stream_snapshots(spark, str(tmp_path / "in"), **limit)
        query = (
            clean_snapshots(stream).writeStream.format("noop")
            .option("checkpointLocation", str(tmp_path / f"ck{len(list(tmp_path.iterdir()))}"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    assert inputs(max_files=2) == [2, 2, 1]
    assert inputs() == [5]
    assert inputs(max_files=None) == [5]
    assert len(inputs(max_bytes=300)) > 1


def test_running_extrema(spark, tmp_path):
    def shape(raw):
        return running_extrema(raw, "v", start_max=25.0)

    probe = Probe(spark, tmp_path / "in", tmp_path / "ck", shape, "complete")
    seen = []
    for number, records in enumerate(FIVE_RUNS[:3]):
        land(tmp_path / "in", number, records)
        probe.run()
        seen.append(probe.take()[-1])
    assert seen == [(25.0, 10.0), (40.0, 10.0), (60.0, 10.0)]
    batch = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    assert running_extrema(batch, "v", start_min=-1.0).first()[:] == (60.0, -1.0)
    several = batch.groupBy("codigo").agg(F.collect_list(F.struct("v")).alias("points"))
    assert running_extrema(added_points(several), "v").first()[:] == (60.0, 10.0)


def test_time_cuts_have_one_length(spark):
    history = spark.range(10).select(F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("ts"))
    assert time_cuts(history, "ts", 10) == []
    assert time_cuts(history, "ts", 4) == ["1970-01-05 00:00:00", "1970-01-09 00:00:00"]
    assert time_cuts(history.filter("ts IS NULL"), "ts", 4) == []


def test_combined_stats_of_a_stream(spark, tmp_path):
    fleet_files(tmp_path / "files")
    for name in ("one", "two"):
        land_file(tmp_path / "files" / name, tmp_path / "landing")
    stream = dedupe_stream(clean_snapshots(stream_snapshots(spark, str(tmp_path / "landing"))), salt_buckets=2)
    seen = []
    query = (
        combined_stats(stream, approx=True)
        .drop("datahora", "window_end")
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .foreachBatch(lambda df, _: seen.extend(rows(df, "corredor", "linha", "vel_media", "qtd_carros")))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(seen) == [
        ("", "99", 7.0, 1),
        ("TransCarioca", "33", 0.0, 1),
        ("TransOeste", "10", 10.0, 1),
        ("TransOeste", "20", 5.0, 1),
    ]


def test_database_sink_gets_all_three_results(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader, DataFrameWriter

    calls = []
    # No batch is in the ledger yet.
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda *_, **__: spark.createDataFrame([], database.LEDGER_SCHEMA))

    def jdbc(self, url, table, mode=None, properties=None):
        calls.append((url, table, mode, properties, self._df.columns, self._df.count()))

    monkeypatch.setattr(DataFrameWriter, "jdbc", jdbc)
    job = config(tmp_path, layout="independent", jdbc_url="jdbc:x", jdbc_properties={"user": "u"})
    fleet_files(tmp_path / "files")
    land_file(tmp_path / "files" / "one", tmp_path / "landing")
    ingest.run_ingest(spark, job)
    written = {c[1]: c for c in calls if c[5]}
    assert set(written) == {"gpsdata", "stats_vel", "stats_qtd", database.LEDGER}
    for table, (url, _, mode, properties, columns, _) in written.items():
        assert (url, mode, properties) == ("jdbc:x", "append", {"user": "u"})
        assert table == database.LEDGER or columns == [*TABLES[table].fieldNames(), database.ATTEMPT]
    assert not (tmp_path / "tables").exists()
    with pytest.raises(ValueError, match="independent"):
        ingest.run_ingest(spark, config(tmp_path, jdbc_url="jdbc:x"))


def test_state_partitions_are_kept_by_the_checkpoint(spark, tmp_path):
    job = config(tmp_path, state_partitions=3)
    fleet_files(tmp_path / "files")
    land_file(tmp_path / "files" / "one", tmp_path / "landing")
    queries = ingest.run_ingest(spark, job)
    states = [o for q in queries for p in q.recentProgress for o in p["stateOperators"]]
    assert states and {o["numShufflePartitions"] for o in states} == {3}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_a_cluster_must_state_its_partitions():
    class Cluster:
        sparkContext = type("Context", (), {"master": "spark://x:1", "defaultParallelism": 2})

    with pytest.raises(ValueError, match="state partitions"):
        ingest.state_partitions(Cluster, None)
    assert ingest.state_partitions(Cluster, 400) == 400
