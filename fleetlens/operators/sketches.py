"""Distinct vehicles from sketches that add up over hours, days and corridors.

A count of distinct vehicles cannot be added to another one, a sketch can. The statistics
keep one sketch per window and corridor; the vehicles of a day, of a corridor or of all
come from the union of theirs. A union takes a sketch that is there twice, or an earlier
update of it, as once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import constants as C
from fleetlens.operators.stats import BY_CORRIDOR, SKETCH, grouped, labelled

# Base-2 logarithm of a sketch's size: 4 KB at most, relative error 1.6 %.
LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """Standard error of a union's estimate, as a share of the count."""
    return 1.04 / math.sqrt(2**lg_k)


def vehicle_sketch(lg_k: int = LG_K) -> Column:
    """Sketch of the distinct vehicles; rows without a vehicle add nothing."""
    return F.hll_sketch_agg("codigo", F.lit(lg_k))


def window_sketches(
    positions: DataFrame,
    window: str = C.STREAM_WINDOW,
    by: Sequence[str] = BY_CORRIDOR,
    lg_k: int = LG_K,
    tz: str | None = None,
) -> DataFrame:
    """Rows of the sketch table; windows in which no vehicle is known are left out."""
    return labelled(grouped(positions, window, by, {SKETCH: vehicle_sketch(lg_k)}), SKETCH, by, True, tz)


def united(column: str = SKETCH) -> Column:
    """Distinct vehicles of all sketches of a group, whatever their sizes."""
    return F.hll_sketch_estimate(F.hll_union_agg(column, F.lit(True))).alias("qtd_carros")


def vehicles_of(sketches: DataFrame, *by: str) -> DataFrame:
    """Distinct vehicles per ``by`` columns, of all updates of all windows in them."""
    return sketches.groupBy(*by).agg(united())


def vehicles_rollup(sketches: DataFrame, *levels: str) -> DataFrame:
    """Distinct vehicles at every level from all ``levels`` up to the whole.

    ``level`` tells how many of them a row keeps. The finest unions come first, so that the
    rows that are repeated per level are one for each finest group.
    """
    finest = sketches.groupBy(*levels).agg(F.hll_union_agg(SKETCH, F.lit(True)).alias(SKETCH))
    level = F.lit(len(levels)) - F.expr("bit_count(grouping_id())")
    return finest.rollup(*levels).agg(level.cast("int").alias("level"), united())
