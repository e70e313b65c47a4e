"""Database sink that appends each batch of a streaming query once.

JDBC writes one transaction per partition, so a batch that breaks off leaves a part of its rows.
Every attempt therefore stages its rows in the table under an id of its own, and counts from
the moment its single row is in the ledger. Readers take the rows whose attempt is in the ledger
(``VIEW``); a batch that is in it is not handed to the database again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.schemas import TABLES, align
from fleetlens.sources.tables import route

LEDGER = "batch_ledger"
# Columns a table needs beside its own, and the ledger, for whoever creates them.
ATTEMPT = "attempt_id"
LEDGER_SCHEMA = "run_id string, batch_id long, table_name string, attempt_id string"
VIEW = "SELECT t.* FROM {table} t JOIN {ledger} l ON l.attempt_id = t.attempt_id"


def append_once(
    df: DataFrame,
    url: str,
    properties: dict[str, str],
    run_id: str,
    batch_id: int,
    table: str | None = None,
    ledger: str = LEDGER,
) -> bool:
    """Append one batch to its table unless the ledger has it; False if it has.

    ``run_id`` must be as old as the query's checkpoint. One writer per run.
    """
    spark, table = df.sparkSession, table or route(df)
    entries = spark.read.jdbc(url, ledger, properties=properties)
    same = (F.col("run_id") == F.lit(run_id)) & (F.col("batch_id") == F.lit(batch_id)) & (F.col("table_name") == F.lit(table))
    if not entries.where(same).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    rows = align(df, TABLES[table]).withColumn(ATTEMPT, F.lit(attempt))
    rows.write.jdbc(url, table, mode="append", properties=properties)
    entry = spark.createDataFrame([(run_id, batch_id, table, attempt)], LEDGER_SCHEMA).coalesce(1)
    entry.write.jdbc(url, ledger, mode="append", properties=properties)
    return True


def read_counted(df_of: Callable[[str], DataFrame], table: str, ledger: str = LEDGER) -> DataFrame:
    """Rows of a table that count; ``df_of`` reads a table of the database by name."""
    own = df_of(ledger).where(F.col("table_name") == F.lit(table)).select(ATTEMPT)
    return df_of(table).join(own, ATTEMPT, "left_semi").drop(ATTEMPT)


def once_writer(
    url: str, properties: dict[str, str], run_id: str, table: str | None = None, ledger: str = LEDGER
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over JDBC that survives replays."""

    def write(df: DataFrame, batch_id: int) -> None:
        append_once(df, url, properties, run_id, batch_id, table, ledger)

    return write
