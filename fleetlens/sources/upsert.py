"""Statistics with one row per window and corridor, kept up to date batch by batch.

The logs of an update-mode stream grow with every update. Here a batch's rows replace those of
the same key: the days they touch are read, merged and written as a new version
(``sources.versions``). A batch that is through is not applied again, so a replay changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import PARTITION, align, stored_schema, with_partition_day
from fleetlens.sources.tables import route
from fleetlens.sources.versions import DayTable

KEYS = ("corredor", "data", "hora")
ORDER = "atualizacao"


def last_of_key(rows: DataFrame, keys: Sequence[str] = KEYS, order: str = ORDER) -> DataFrame:
    """The row of each key with the latest ``order``; of equally late ones the largest.

    Partial aggregation leaves one row per key and task before the shuffle.
    """
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = F.max(F.struct(order, *rest)).alias("row")
    return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"row.{c}") for c in rows.columns])


def upsert_batch(
    df: DataFrame,
    root: str,
    run_id: str,
    batch_id: int,
    table: str | None = None,
    keys: Sequence[str] = KEYS,
    order: str = ORDER,
) -> bool:
    """Merge one batch into its table; False if it was merged before."""
    table = table or route(df)
    versions = DayTable(df.sparkSession, root, table)
    if versions.committed(run_id, batch_id):
        return False
    version = versions.last_version() + 1
    rows = align(with_partition_day(df), stored_schema(table))
    # The batch is read three times: for its bounds, for the merge, for its days.
    rows.persist()
    try:
        day = F.col(PARTITION.name)
        low, high = rows.agg(F.min(day), F.max(day)).first()
        days = rows.select(PARTITION.name).where(day.isNotNull()).distinct()
        if low is not None:
            old = versions.read().where(day.between(F.lit(low), F.lit(high))).join(days, PARTITION.name, "left_semi")
            versions.write(last_of_key(old.unionByName(rows.where(day.isNotNull())), keys, order), version)
        versions.commit(version, days, run_id, batch_id)
    finally:
        rows.unpersist()
    return True


def upsert_writer(root: str, run_id: str, table: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function; ``run_id`` must be as old as the query's checkpoint."""

    def write(df: DataFrame, batch_id: int) -> None:
        upsert_batch(df, root, run_id, batch_id, table)

    return write


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One row per key, as of the last batch that is through."""
    return DayTable(spark, root, table).read()
