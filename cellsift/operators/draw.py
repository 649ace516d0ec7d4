"""Draws without replacement: the k smallest race keys of each group.

A group may hold a third of all rows, so no group is ever sorted whole.  A first
pass counts rows per narrow slice of the key; the slices below the k-th row are
taken unseen and only the slice that holds the k-th row is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsift.functions.keys import race_key, uniform_key
from cellsift.session import small_side

#: Slices per doubling of the key; 32 leave about two percent of k in the last
#: slice.  More are used when k is large.
SLICES_PER_OCTAVE = 32
ROWS_PER_TASK = 1_000_000


def _slice(key: Column, k: int) -> Column:
    finer = min(max(1, -(-k // ROWS_PER_TASK)), 2048)
    return F.floor(F.log2(key) * F.lit(SLICES_PER_OCTAVE * finer))


def smallest_k(
    df: DataFrame,
    k: int,
    key: str,
    id_cols: Sequence[str],
    group_cols: Sequence[str],
    short: str = "raise",
) -> DataFrame:
    """Rows with the ``k`` smallest positive ``key`` in each group, ties by id.

    ``short`` says what a group of fewer than ``k`` rows does: ``raise``, or
    ``all`` to keep every row.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    group = list(group_cols)
    sliced = df.withColumn("_slice", _slice(F.col(key), k))

    counts = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy("_slice"))
    cuts = (
        counts.withColumn("_upto", upto)
        .groupBy(*group)
        .agg(
            F.min(F.when(F.col("_upto") >= k, F.struct("_slice", (k - F.col("_upto") + F.col("_n")).alias("need")))).alias("_c"),
            F.max("_upto").alias("_total"),
        )
    )
    if short == "raise":
        too_few = F.raise_error(F.format_string("a draw of %d was asked of a group with %d candidates", F.lit(k), F.col("_total")))
        cuts = cuts.withColumn("_c", F.when(F.col("_total") < k, too_few.cast(cuts.schema["_c"].dataType)).otherwise(F.col("_c")))
    cuts = cuts.select(*group, F.col("_c._slice").alias("_last"), F.col("_c.need").alias("_need"))

    near = sliced.join(small_side(cuts), group).where(
        F.col("_last").isNull() | (F.col("_slice") <= F.col("_last"))
    )
    # Rows below the last slice are in already; they are spread so that only
    # the last slice shares a window partition.
    inner = F.col("_last").isNull() | (F.col("_slice") < F.col("_last"))
    spread = F.lit(1) + F.pmod(F.hash(*id_cols), F.lit(max(8, k // ROWS_PER_TASK)))
    lane = F.when(inner, spread).otherwise(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*group, "_lane").orderBy(key, *id_cols))
    return (
        near.withColumn("_lane", lane)
        .withColumn("_rank", rank)
        .where((F.col("_lane") > 0) | (F.col("_rank") <= F.col("_need")))
        .drop("_slice", "_last", "_need", "_lane", "_rank")
    )


def draw(
    df: DataFrame,
    k: int,
    id_cols: Sequence[str],
    group_cols: Sequence[str],
    weight: str | None = None,
    seed: int | str = 0,
    short: str = "raise",
) -> DataFrame:
    """``k`` rows per group without replacement, by ``weight`` or uniformly.

    The key covers the group columns, so draws differ between groups.
    """
    parts = list(dict.fromkeys([*group_cols, *id_cols]))
    key = race_key(uniform_key(parts, seed), None if weight is None else F.col(weight))
    if weight is not None:
        df = df.where(F.col(weight) > 0)
    return smallest_k(df.withColumn("_race", key), k, "_race", id_cols, group_cols, short).drop("_race")


def not_yet_chosen(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that are not in ``chosen``, for a top-up draw."""
    return df.join(small_side(chosen.select(*keys).distinct()), list(keys), "left_anti")
