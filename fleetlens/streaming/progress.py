"""Progress reports of streaming queries as a table that outlives them.

A query keeps its last hundred reports in memory and loses them when it stops. The listener
writes each report's counts down: rows read, rows the watermark dropped, rows held in state.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

SCHEMA = """query_id string, run_id string, name string, batch_id long, reported timestamp, watermark timestamp,
    input_rows long, dropped_rows long, state_rows long, state_bytes long, batch_ms long"""
# Seconds a bounded run waits for its last report.
PATIENCE = 60


def report(progress) -> tuple:
    """One progress report as a row; counts are sums over the query's stateful operators."""
    states = progress.stateOperators
    watermark = (progress.eventTime or {}).get("watermark")
    return (
        str(progress.id),
        str(progress.runId),
        progress.name,
        progress.batchId,
        progress.timestamp,
        watermark,
        progress.numInputRows,
        sum(s.numRowsDroppedByWatermark for s in states),
        sum(s.numRowsTotal for s in states),
        sum(s.memoryUsedBytes for s in states),
        progress.batchDuration,
    )


class ProgressTable(StreamingQueryListener):
    """Listener that appends reports to ``path``, ``every`` so many of them.

    Reports are written when a query ends, too. Should one be written twice, or a batch run
    again, readers take the last.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 1):
        self.spark, self.path, self.every = spark, path, every
        self.rows: list[tuple] = []
        self.lock = threading.Lock()
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        with self.lock:
            self.rows.append(report(event.progress))
            full = len(self.rows) >= self.every
        if full:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            texts = SCHEMA.replace("timestamp", "string")
            stamped = self.spark.createDataFrame(rows, texts).withColumns(
                {c: F.to_timestamp(c) for c in ("reported", "watermark")}
            )
            stamped.coalesce(1).write.mode("append").parquet(self.path)

    def finish(self, query: StreamingQuery) -> None:
        """Wait until a bounded run has ended and its reports are written."""
        query.awaitTermination()
        if not self.ended.setdefault(str(query.runId), threading.Event()).wait(PATIENCE):
            raise TimeoutError(f"no last report of query {query.name}")


@contextmanager
def recording(spark: SparkSession, path: str, every: int = 1) -> Iterator[ProgressTable]:
    """Record all queries of the session for the time of the block."""
    listener = ProgressTable(spark, path, every)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The last report of each batch of each query."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    rest = [c for c in rows.columns if c not in ("query_id", "batch_id")]
    last = F.max(F.struct("reported", *[c for c in rest if c != "reported"])).alias("r")
    return rows.groupBy("query_id", "batch_id").agg(last).select("query_id", "batch_id", *[f"r.{c}" for c in rest])


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Per query: batches, rows read and dropped over its life, state as of its last batch."""
    state = F.max(F.struct("batch_id", "state_rows"))["state_rows"]
    return read_progress(spark, path).groupBy("query_id").agg(
        F.max("name").alias("name"),
        F.count("*").alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        F.sum("dropped_rows").alias("dropped_rows"),
        state.alias("state_rows"),
    )
