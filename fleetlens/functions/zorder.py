"""Space-filling keys: places that are near each other get keys that are near each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits per axis; two axes make a key of 60 bits.
BITS = 30
# Each step doubles the distance between groups of bits: shift, and the bits kept after it.
SPREAD = [
    (16, 0x0000FFFF0000FFFF),
    (8, 0x00FF00FF00FF00FF),
    (4, 0x0F0F0F0F0F0F0F0F),
    (2, 0x3333333333333333),
    (1, 0x5555555555555555),
]


def spread_bits(value: Column) -> Column:
    """The lower 32 bits of a whole number, one place between each and the next."""
    out = value.cast("long").bitwiseAND(0xFFFFFFFF)
    for shift, mask in SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def gather_bits(value: Column) -> Column:
    """Every second bit, from the lowest on: what ``spread_bits`` spread."""
    out = value.bitwiseAND(F.lit(SPREAD[-1][1]).cast("long"))
    for (shift, _), (_, mask) in zip(reversed(SPREAD), [*reversed(SPREAD[:-1]), (0, 0x00000000FFFFFFFF)]):
        out = out.bitwiseOR(F.shiftright(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def interleaved(x: Column, y: Column) -> Column:
    """Key of a cell: the bits of ``x`` and ``y`` in turn. Its parent cell's key is that without two bits."""
    return spread_bits(x).bitwiseOR(F.shiftleft(spread_bits(y), 1))


def axis_cell(value: Column, low: float, high: float, bits: int) -> Column:
    """Cell of a value on an axis, in one of ``2^bits``; values beyond the ends are in the outermost
    ones, a null in none."""
    cells = float(2**bits)
    cell = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(cells))
    return F.when(value.isNotNull(), F.least(F.greatest(cell, F.lit(0)), F.lit(2**bits - 1)))


def z_key(lat: Column, lng: Column, bits: int = BITS) -> Column:
    """Key of a place; a place without coordinates has none."""
    return interleaved(axis_cell(lng, -180.0, 180.0, bits), axis_cell(lat, -90.0, 90.0, bits))
