"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Skew-join and partition coalescing are on by default with AQE; the parallelism
# itself stays with the cluster's own settings.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# What one shuffle partition should hold.
PARTITION_BYTES = 256 * 1024 * 1024


def shuffle_conf(expected_bytes: int, partition_bytes: int = PARTITION_BYTES) -> dict[str, str]:
    """Settings for shuffles of up to ``expected_bytes``.

    AQE joins small partitions but never makes more than a shuffle starts with, so
    a job over terabytes must start with enough of them to fit in memory.
    """
    partitions = max(-(-expected_bytes // partition_bytes), 1)
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
    }


def build_session(
    app: str = "fleetlens", master: str | None = None, expected_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with the settings the jobs expect; ``conf`` names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sizes = shuffle_conf(expected_bytes) if expected_bytes else {}
    for key, value in {**BASE_CONF, **sizes, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def scoped_conf(
    spark: SparkSession, settings: Mapping[str, str], overrides: Mapping[str, str] | None = None
) -> Iterator[None]:
    """Apply settings the user has not set, and ``overrides``, for the time a query is started.

    A streaming query keeps the settings it was started with.
    """
    own = {key: value for key, value in settings.items() if spark.conf.get(key, None) is None}
    changed = {**own, **(overrides or {})}
    old = {key: spark.conf.get(key, None) for key in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@cache
def local_base() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new path under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may leave that setting out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = local_base()
    return f"{base.rstrip('/')}/fleetlens/{purpose}-{uuid.uuid4().hex}"


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a shuffle of this session starts with."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(first or spark.conf.get(SHUFFLE_PARTITIONS))


def state_partitions(spark: SparkSession, wanted: int | None) -> int:
    """Partitions of streaming state.

    A checkpoint keeps its number for good, so on a cluster it must be stated: the
    executors that happen to be registered when a job starts tell nothing. Only a local
    session may leave it out.
    """
    if wanted is not None:
        return wanted
    if not is_local(spark):
        raise ValueError("state the number of state partitions: a checkpoint keeps it for good")
    return int(spark.conf.get(SHUFFLE_PARTITIONS, str(spark.sparkContext.defaultParallelism)))
