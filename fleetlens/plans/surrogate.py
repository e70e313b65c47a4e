"""Feed-shaped views over the test tables (no vehicle feed is among them).

Every row of a table becomes one record; nothing is left out here.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.positions import clean
from fleetlens.operators.stats import BY_CORRIDOR
from fleetlens.schemas import STATION

ANCHOR = "2024-01-30"
SCALE = 2  # decimals the measured values have
UPDATE_MINUTES = 20


# Declared, so that no file is opened before the query runs.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_returnflag string, l_linestatus string",
}

# Vehicle fields made from an event, without its time.
LINE_NUMBER = "CAST(10 + event_id % 55 AS STRING)"
FEED = {
    "codigo": "CAST(user_id AS STRING)",
    "linha": f"""CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '123'
        WHEN event_id % 7 = 0 THEN '501234' WHEN event_id % 5 = 0 THEN '20A' ELSE {LINE_NUMBER} END""",
    "latitude": "-23.1D + (user_id % 100) * 0.004D",
    "longitude": "-43.8D + (user_id % 140) * 0.005D",
    "velocidade": "CASE WHEN event_id % 23 = 0 THEN 0.0D ELSE value END",
    "sentido": "CASE WHEN event_id % 2 = 0 THEN 'ida' ELSE 'volta' END",
    "trajeto": f"""CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'expresso - x'
        ELSE concat({LINE_NUMBER}, ' - ', event_type) END""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def snapshots(
    spark: SparkSession,
    sf_dir: str,
    since: str | None = None,
    until: str | None = None,
    repeats: bool = False,
    where: str = "true",
) -> DataFrame:
    """Snapshot documents; with ``repeats`` every third vehicle is in its document twice."""
    events = table(spark, sf_dir, "events").filter(where)
    if since is not None:
        events = events.filter(f"ts >= TIMESTAMP_NTZ '{since}'")
    if until is not None:
        events = events.filter(f"ts < TIMESTAMP_NTZ '{until}'")
    fields = {**FEED, "datahora": "unix_micros(CAST(ts AS TIMESTAMP)) / 1000.0D"}
    vehicle = "named_struct(" + ", ".join(f"'{name}', {expr}" for name, expr in fields.items()) + ")"
    times = "CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END"
    content = f"array_repeat({vehicle}, {times})" if repeats else f"array({vehicle})"
    return events.selectExpr(f"{content} AS veiculos")


def positions(spark: SparkSession, sf_dir: str, since: datetime | None = None) -> DataFrame:
    """Clean positions, times without zone as the table has them.

    ``since`` bounds the raw time, which the scan can use; Spark cannot infer that bound
    from one on the time cut to seconds.
    """
    fields = {("codlinha" if name == "linha" else name): expr for name, expr in FEED.items()}
    events = table(spark, sf_dir, "events")
    if since is not None:
        events = events.filter(f"ts >= TIMESTAMP_NTZ '{since.isoformat(sep=' ')}'")
    records = events.selectExpr(
        "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) AS datahora",
        *[f"{expr} AS {name}" for name, expr in fields.items()],
    )
    return clean(records)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as (lat, lng, count) points."""
    return positions(spark, sf_dir).selectExpr("latitude AS lat", "longitude AS lng", "velocidade AS count")


# Hour of a ping and number of the 20-minute update it is first part of.
HOUR = "CAST(date_trunc('hour', datahora) AS TIMESTAMP_NTZ) AS hour"
SLOT = f"CAST(minute(datahora) / {UPDATE_MINUTES} AS INT) AS slot"


def log_rows(updates: DataFrame, measure: str) -> DataFrame:
    return updates.filter(f"{measure} > 0").selectExpr(
        *BY_CORRIDOR,
        measure,
        "to_date(hour) AS data",
        "date_format(hour, 'HH:mm') AS hora",
        f"hour + make_dt_interval(0, 0, (slot + 1) * {UPDATE_MINUTES}) AS atualizacao",
    )


def speed_log(spark: SparkSession, sf_dir: str, since: datetime | None = None) -> DataFrame:
    """Speed log as an update-mode stream leaves it: hourly means so far, every 20 minutes.

    Pings are summed per update first; the running sums go over three rows an hour.
    ``since`` must be a full hour: hours are then in the log whole or not at all.
    """
    parts = (
        positions(spark, sf_dir, since)
        .selectExpr(HOUR, SLOT, *BY_CORRIDOR, f"CAST(velocidade AS DECIMAL(18,{SCALE})) AS v")
        .groupBy("hour", *BY_CORRIDOR, "slot")
        .agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    )
    so_far = Window.partitionBy("hour", *BY_CORRIDOR).orderBy("slot")
    mean = F.sum("s").over(so_far).cast("double") / F.sum("n").over(so_far)
    return log_rows(parts.withColumn("vel_media", mean), "vel_media")


def vehicle_log(spark: SparkSession, sf_dir: str, since: datetime | None = None) -> DataFrame:
    """Vehicle log in the same form, exact counts."""
    first_seen = (
        positions(spark, sf_dir, since)
        .selectExpr(HOUR, SLOT, *BY_CORRIDOR, "codigo")
        .groupBy("hour", *BY_CORRIDOR, "codigo")
        .agg(F.min("slot").alias("slot"))
    )
    parts = first_seen.groupBy("hour", *BY_CORRIDOR, "slot").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("hour", *BY_CORRIDOR).orderBy("slot")
    return log_rows(parts.withColumn("qtd_carros", F.sum("n").over(so_far)), "qtd_carros")


def stations(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three station sources, one per table of named places."""

    def shape(name: str, key: str, label: str, district: str) -> DataFrame:
        digits = f"lpad(CAST({key} % 10000 AS STRING), 4, '0')"
        fields = {
            "estacao": label,
            "horarioestacao": f"CASE WHEN {key} % 2 = 0 THEN '24h' ELSE '05h à 01h' END",
            "horariobilheteria": "'06h às 22h'",
            "logradouro": "'Avenida'",
            "numero": f"CASE WHEN {key} % 3 = 0 THEN '' ELSE CAST({key} AS STRING) END",
            "bairro": f"CAST({district} AS STRING)",
            "latitude": f"CASE WHEN {key} % 7 = 0 THEN 'sem dado' ELSE concat('-22.', {digits}) END",
            "longitude": f"concat(' -43.', {digits}, CASE WHEN {key} % 5 = 0 THEN ' graus' ELSE '' END)",
        }
        return table(spark, sf_dir, name).selectExpr(*[f"{fields[f]} AS {f}" for f in STATION.fieldNames()])

    return {
        "nation": shape("nation", "n_nationkey", "n_name", "n_regionkey"),
        "supplier": shape("supplier", "s_suppkey", "s_name", "s_nationkey"),
        "customer": shape("customer", "c_custkey", "c_name", "c_mktsegment"),
    }


def itinerary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops in order: an order's line items, each at its supplier's station."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS linha",
        "CASE WHEN l_returnflag = 'R' THEN 'volta' ELSE 'ida' END AS sentido",
        "l_linestatus AS trajeto",
        "l_returnflag AS destino",
        "l_linenumber AS sequencia",
        "concat('Supplier#', lpad(CAST(l_suppkey AS STRING), 9, '0')) AS estacao",
    )


def year_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects keyed by year: two years an order, the second with one value only."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        """to_json(map(CAST(year(o_orderdate) AS STRING), array(o_totalprice, CAST(o_custkey AS DOUBLE)),
            CAST(year(o_orderdate) + 1 AS STRING), array(CAST(o_orderkey AS DOUBLE)))) AS body""",
    )


def country_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year objects with the country of the order's customer."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    homes = customer.join(nation, customer.c_nationkey == nation.n_nationkey).selectExpr(
        "c_custkey AS o_custkey", "n_name AS country"
    )
    return year_objects(spark, sf_dir).join(homes, "o_custkey").select("o_orderkey", "country", "body")


def metric_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects of metrics by year: an order's metrics depend on its customer, and one is a list."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        """concat('{"', year(o_orderdate), '": {"internet": ', o_totalprice, ', "m', o_custkey % 5, '": ', o_custkey,
            ', "note": "x"}, "', year(o_orderdate) + 1, '": [', o_orderkey, ']}') AS body""",
    )
