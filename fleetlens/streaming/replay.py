"""Replay of a bounded history through a streaming job."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(slices: Iterable[DataFrame], landing: str, run: Callable[[], None]) -> None:
    """Land snapshot slices one after another and run the job after each.

    Slices in event-time order behave as a live feed does: the watermark moves
    with them, state of closed windows is freed, and each run restarts the
    job from its checkpoint. ``run`` must end when everything landed is processed.
    """
    for snapshots in slices:
        snapshots.write.mode("append").json(landing)
        run()


def time_cuts(history: DataFrame, time: str, days: int) -> list[str]:
    """Times that cut a history into slices of ``days`` days from its first row on.

    The length of a slice is event time, so the number of rows plays no part.
    """
    first, last = history.agg(F.min(time).cast("string"), F.max(time).cast("string")).first()
    if first is None:
        return []
    start, end = datetime.fromisoformat(first), datetime.fromisoformat(last)
    steps = range(1, (end - start) // timedelta(days=days) + 1)
    return [(start + timedelta(days=days * i)).isoformat(sep=" ") for i in steps]
