"""Seeded keys: the same number for the same row on every cluster layout.

``rand()`` depends on partitioning, so a retried task or another cluster would
draw another sample.  A key hashed from the row's identity does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hexadecimal digits are 52 bits, so key + 1 over 2^52 + 1
# lies strictly between 0 and 1 and is exact in a double.
HEX_DIGITS = 13
KEY_SPAN = 4503599627370497.0


def uniform_key(parts: Sequence[str | Column], seed: int | str | Column = 0) -> Column:
    """A uniform number in (0, 1) from the text of ``parts`` and ``seed``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols], seed if isinstance(seed, Column) else F.lit(str(seed)))
    number = F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")
    return (number + F.lit(1)) / F.lit(KEY_SPAN)


def race_key(uniform: Column, weight: Column | None = None) -> Column:
    """Exponential race time: the k smallest are a weighted draw without
    replacement (Efraimidis and Spirakis)."""
    time = -F.log(uniform)
    return time if weight is None else time / weight
