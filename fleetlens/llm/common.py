"""What the operators share: staging in the shared folder and Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fleetlens.session import scoped_conf, scratch_dir

# Texts that a function of whole texts gets at once.
TEXTS_AT_ONCE = 500

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts lineage in a way that outlives executors, and keeps costly columns from
    being computed once per use.
    """
    path = scratch_dir(df.sparkSession, purpose)
    # What the write shuffled is not needed once it is written.
    with scoped_conf(df.sparkSession, {CLEANUP: "true"}):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows_at_once(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows, for rows that are megabytes each."""
    return scoped_conf(spark, {}, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(
    df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str | StructType, at_once: int | None = None
) -> DataFrame:
    """``rows`` turns an Arrow batch, or ``at_once`` rows of it, into columns of ``schema``, without a shuffle."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            step = at_once or max(batch.num_rows, 1)
            for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                columns = rows(part)
                yield pa.RecordBatch.from_arrays(
                    [as_array(columns[field.name], field.type) for field in arrow], schema=arrow
                )

    return df.mapInArrow(run, target)


def map_texts(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """``map_batches`` for ``rows`` that makes objects of whole texts: it gets few rows at a time, and hands on as few."""
    return map_batches(df, rows, schema, TEXTS_AT_ONCE)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """UTF-8 bytes of a text column, one value at a time; null reads as empty."""
    for value in batch.column(column):
        raw = value.as_buffer()
        yield raw.to_pybytes() if raw is not None else b""


def printable() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, reversed.

    Bytes that print stand for themselves, the others take the characters from 256 on in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


PRINTABLE = printable()


def bytes_of(word: str) -> bytes:
    """Bytes of an entry of a byte-level vocabulary."""
    return bytes(PRINTABLE[c] for c in word)
