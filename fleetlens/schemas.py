"""Declared schemas of the snapshot files, the station files and the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The feed's ``id_migracao`` is left out on purpose: nothing uses it, and JSON
# scans do not prune fields inside an array, so declaring it would parse it.
VEHICLE = T.StructType(
    [
        T.StructField("codigo", T.StringType()),
        T.StructField("linha", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("datahora", T.DoubleType()),
        T.StructField("velocidade", T.DoubleType()),
        T.StructField("sentido", T.StringType()),
        T.StructField("trajeto", T.StringType()),
    ]
)

SNAPSHOT = T.StructType([T.StructField("veiculos", T.ArrayType(VEHICLE))])

STATION = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "estacao",
            "horarioestacao",
            "horariobilheteria",
            "logradouro",
            "numero",
            "bairro",
            "latitude",
            "longitude",
        )
    ]
)

GPSDATA = T.StructType(
    [
        T.StructField("codigo", T.StringType()),
        T.StructField("linha", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("datahora", T.TimestampType()),
        T.StructField("velocidade", T.DoubleType()),
        T.StructField("sentido", T.StringType()),
        T.StructField("trajeto", T.StringType()),
        T.StructField("corredor", T.StringType()),
    ]
)

STATS_VEL = T.StructType(
    [
        T.StructField("corredor", T.StringType()),
        T.StructField("vel_media", T.DoubleType()),
        T.StructField("data", T.DateType()),
        T.StructField("hora", T.StringType()),
        T.StructField("atualizacao", T.TimestampType()),
    ]
)

STATS_QTD = T.StructType(
    [
        T.StructField("corredor", T.StringType()),
        T.StructField("qtd_carros", T.LongType()),
        T.StructField("data", T.DateType()),
        T.StructField("hora", T.StringType()),
        T.StructField("atualizacao", T.TimestampType()),
    ]
)

# Sketches of distinct vehicles, which add up where the counts of ``stats_qtd`` do not.
STATS_SKETCH = T.StructType(
    [
        T.StructField("corredor", T.StringType()),
        T.StructField("carros", T.BinaryType()),
        T.StructField("data", T.DateType()),
        T.StructField("hora", T.StringType()),
        T.StructField("atualizacao", T.TimestampType()),
    ]
)

STATS = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("corredor", T.StringType()),
        T.StructField("linha", T.StringType()),
        T.StructField("sentido", T.StringType()),
        T.StructField("vel_media", T.DoubleType()),
        T.StructField("qtd_carros", T.LongType()),
        T.StructField("datahora", T.TimestampType()),
    ]
)

ITINERARY = T.StructType(
    [
        T.StructField("linha", T.LongType()),
        T.StructField("sentido", T.StringType()),
        T.StructField("trajeto", T.StringType()),
        T.StructField("destino", T.StringType()),
        T.StructField("sequencia", T.IntegerType()),
        T.StructField("estacao", T.StringType()),
    ]
)

TABLES = {
    "gpsdata": GPSDATA,
    "stats_vel": STATS_VEL,
    "stats_qtd": STATS_QTD,
    "stats_sketch": STATS_SKETCH,
    # Pings whose hour was closed when they came.
    "gpsdata_late": GPSDATA,
}

# Every table is partitioned by day. ``gpsdata`` has no day of its own, so one
# is derived from ``datahora`` when it is written.
PARTITION = T.StructField("data", T.DateType())


def stored_schema(table: str) -> T.StructType:
    """Columns as they lie on disk: the table's own, with the partition day last."""
    own = [f for f in TABLES[table].fields if f.name != PARTITION.name]
    return T.StructType(own + [PARTITION])


def with_partition_day(df: DataFrame) -> DataFrame:
    """Add the partition day from the event time where the rows do not have one."""
    if PARTITION.name in df.columns:
        return df
    return df.withColumn(PARTITION.name, partition_day(F.col("datahora"), df.schema["datahora"].dataType))


def partition_day(time: Column, kind: T.DataType) -> Column:
    """The day of an event time in UTC, whatever the session's zone; a time without zone has its own."""
    if isinstance(kind, T.TimestampNTZType):
        return F.to_date(time)
    return F.date_from_unix_date(F.floor(F.unix_seconds(time) / F.lit(86400)).cast("int"))


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Match by column name: schema order and types, absent columns as real nulls."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """Create the tables in the session catalog, partitioned by day."""
    for table in TABLES:
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored_schema(table).fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) "
            f"USING parquet PARTITIONED BY ({PARTITION.name})"
        )


def append_to_catalog(df: DataFrame, table: str, database: str = "default") -> None:
    """Append rows to a catalog table, columns matched by name."""
    rows = align(with_partition_day(df), stored_schema(table))
    rows.sparkSession.sql(f"INSERT INTO {database}.{table} BY NAME SELECT * FROM {{rows}}", rows=rows)
