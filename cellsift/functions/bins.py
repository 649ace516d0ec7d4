"""Bin arithmetic shared by every histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin of ``value``; the last bin is closed on the right.

    A constant column gets the range value - 0.5 .. value + 0.5.  Values outside
    the range go to the nearest end bin.
    """
    flat = low == high
    lo = F.when(flat, low - F.lit(0.5)).otherwise(low)
    hi = F.when(flat, high + F.lit(0.5)).otherwise(high)
    raw = F.floor((value - lo) / (hi - lo) * F.lit(bins))
    return F.greatest(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("long")


def flat_bin(axis_bins: Sequence[Column], bins: int) -> Column:
    """One row-major id from the bin of each axis."""
    flat = axis_bins[0]
    for axis in axis_bins[1:]:
        flat = flat * F.lit(bins) + axis
    return flat.cast("long")


def bin_key(axis_bins: Sequence[Column], bins: int) -> Column:
    """What tells the bins of a space apart, in row-major order: the flat id where a
    long holds all of them, else the array of the axes' bins."""
    if bins ** len(axis_bins) < 1 << 63:
        return flat_bin(axis_bins, bins)
    kind = "tinyint" if bins < 128 else "int"
    return F.array(*[b.cast(kind) for b in axis_bins])
