"""The registered queries and what their modules share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import recent
from fleetlens.plans import surrogate as S

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the test tables have them."""
    return df.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def before(**span: int) -> datetime:
    """A time before the anchor."""
    return recent.as_moment(S.ANCHOR) - timedelta(**span)
