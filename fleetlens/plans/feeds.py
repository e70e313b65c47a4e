"""Replays of the whole history, for the registered stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans import surrogate as S
from fleetlens.session import scratch_dir
from fleetlens.streaming import ingest
from fleetlens.streaming.replay import time_cuts

# Times the replayed history is cut at, within an hour so that windows span two runs.
CUTS = ("2024-01-11 12:30:00", "2024-01-21 06:40:00")
# Days of one replayed slice, each of which is one micro-batch.
SLICE_DAYS = 30


def slices(spark: SparkSession, sf_dir: str, fixed: bool = False) -> list[DataFrame]:
    """The whole history cut by time: where an hour is split, and every ``SLICE_DAYS`` days.

    Only the fixed cuts are made for queries whose result depends on them.
    """
    cuts = set(CUTS)
    if not fixed:
        cuts |= set(time_cuts(S.table(spark, sf_dir, "events"), "ts", SLICE_DAYS))
    edges = [None, *sorted(cuts), None]
    return [S.snapshots(spark, sf_dir, lo, hi, repeats=True) for lo, hi in zip(edges, edges[1:])]


def stream_config(spark: SparkSession) -> ingest.IngestConfig:
    """New folders and query names; a landed slice is one micro-batch."""
    root = scratch_dir(spark, "stream")
    return ingest.IngestConfig(
        f"{root}/landing",
        f"{root}/tables",
        f"{root}/checkpoints",
        name_prefix=f"{root.rsplit('-', 1)[-1]}-",
        exact_scale=S.SCALE,
        max_files=None,
        state_partitions=int(spark.conf.get("spark.sql.shuffle.partitions")),
    )
