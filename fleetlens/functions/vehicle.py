"""Expressions on the fields of one vehicle record."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import constants as C

# Microseconds of a timestamp are a 64-bit number.
LAST_MS = 9.2e15


def event_time(epoch_ms: Column) -> Column:
    """Epoch milliseconds to a timestamp cut to whole seconds; null where no timestamp holds it."""
    ms = F.when(F.abs(epoch_ms) < F.lit(LAST_MS), epoch_ms)
    return F.timestamp_seconds((ms / F.lit(1000)).cast("long"))


def text_list(values: Iterable[str]) -> str:
    """Constant texts as a SQL list."""
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def like_any(column: str, patterns: Iterable[str]) -> Column:
    """True where the column matches one of the LIKE patterns."""
    return F.expr(f"{column} LIKE ANY ({text_list(patterns)})")


def line_of_route(route: str) -> Column:
    """The part of the route name before the first hyphen."""
    return F.expr(f"trim(split({route}, '-')[0])")


def corridor_of_line(line: str) -> Column:
    """Corridor by the line's first character, empty text when there is none."""
    cases = " ".join(f"WHEN '{digit}' THEN '{name}'" for digit, name in C.CORRIDOR_OF_DIGIT.items())
    return F.expr(f"CASE substring({line}, 1, 1) {cases} ELSE '{C.NO_CORRIDOR}' END")


def corridor_icon(corridor: str) -> Column:
    """Marker icon of a corridor, null when it has none."""
    cases = " ".join(f"WHEN '{name}' THEN '{icon}'" for name, icon in C.CORRIDOR_ICONS.items())
    return F.expr(f"CASE {corridor} {cases} END")


def parse_float(text: Column) -> Column:
    """Number at the start of a text, null when there is none (never an error)."""
    number = F.regexp_extract(text, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)", 1)
    return number.try_cast("double")


def mean(value: Column, exact_scale: int | None = None) -> Column:
    """Mean of a column.

    With ``exact_scale`` the sum is taken in decimals of that scale, so it does
    not depend on the order in which partial sums are merged.
    """
    if exact_scale is None:
        return F.avg(value)
    return total(value, exact_scale) / F.count(value)


def summand(value: Column, exact_scale: int | None = None) -> Column:
    """What is added up: the value, or a decimal, whose sums do not depend on their order."""
    return value if exact_scale is None else value.cast(f"decimal(18,{exact_scale})")


def total(value: Column, exact_scale: int | None = None) -> Column:
    if exact_scale is None:
        return F.sum(value)
    return F.sum(summand(value, exact_scale)).cast("double")
