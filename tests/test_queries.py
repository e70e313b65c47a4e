"""Registered queries against their SQL, and the shape of their plans."""

import re
import sys
from collections import Counter

import duckdb
import pytest
from helpers import plan_of

from __spark_entry__ import entry
from fleetlens.plans import jobs
from fleetlens.plans.oracle import oracles as oracle_sql
from fleetlens.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def queries():
    return QUERIES


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents labels".split():
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, SF_DIR)
    got = df.collect()
    want = db.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert counted(df.columns, got) == counted(want.columns, want.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["corredor", "vel_media", "data", "hora"]


BATCH = sorted(n for n in queries() if not n.startswith("stream_"))


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SF_DIR))
    for word in ("Cartesian", "NestedLoop", "Python", "Pandas", "SinglePartition, REPARTITION"):
        assert word not in plan


@pytest.mark.parametrize("name", ["speed_10m", "heat_grid", "viewport_extrema", "line_group_join"])
def test_scan_reads_needed_columns_only(spark, name):
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan_of(queries()[name](spark, SF_DIR))).group(1)
    assert "props" not in schema


SERVING = sorted(
    n for n in queries() if re.match(r"(speed|vehicles?)_(by|series|chart)|categories|recent|marker|heat_points", n)
)


@pytest.mark.parametrize("name", SERVING)
def test_serving_scan_is_bounded(spark, name):
    assert "GreaterThanOrEqual(ts" in plan_of(queries()[name](spark, SF_DIR))


def test_batch_job_prints(spark, tmp_path, capfd, monkeypatch):
    from helpers import vehicle, write_snapshot

    path = write_snapshot(tmp_path, "20170817182501", [vehicle("A", "50", "50 - x", 40.0)])
    monkeypatch.setattr(jobs, "build_session", lambda app, **_: spark)
    jobs.main(["batch", str(path)])
    printed = capfd.readouterr().out
    assert "vel_media" in printed and "qtd_carros" in printed and "TransOlímpica" in printed


def test_ingest_job(spark, tmp_path, monkeypatch):
    from helpers import vehicle, write_snapshot

    from fleetlens.sources.tables import read_table

    write_snapshot(tmp_path / "in", "20170817182501", [vehicle("A", "50", "50 - x", 40.0)])
    monkeypatch.setattr(jobs, "build_session", lambda app, **_: spark)
    folders = [str(tmp_path / n) for n in ("in", "out", "ck")]
    jobs.main(["ingest", *folders, "--trigger", "availableNow", "--tz", "America/Sao_Paulo"])
    assert read_table(spark, folders[1], "stats_vel").first().hora == "07:00"
    with pytest.raises(SystemExit):
        jobs.parse(["ingest", "only-one"])
    assert "fleetlens.plans.jobs" in sys.modules


def test_ingest_command_line_reaches_the_job(tmp_path):
    secrets = tmp_path / "db.json"
    secrets.write_text('{"user": "u", "password": "p"}')
    more = "--window|2 hours|--delay|5 minutes|--state-partitions|64|--salt-buckets|1|--files-per-batch|2".split("|")
    args = jobs.parse(["ingest", "in", "out", "ck", *more, "--jdbc-url", "jdbc:x", "--jdbc-properties", str(secrets)])
    job = jobs.ingest_config(args)
    assert (job.window, job.delay, job.state_partitions, job.salt_buckets) == ("2 hours", "5 minutes", 64, 1)
    assert (job.files_per_batch, job.layout, job.jdbc_url) == (2, "independent", "jdbc:x")
    assert job.jdbc_properties == {"user": "u", "password": "p"} and "password" not in repr(job)
    assert jobs.ingest_config(jobs.parse(["ingest", "in", "out", "ck"])).layout == "shared"
