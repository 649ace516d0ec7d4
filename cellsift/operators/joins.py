"""Alignment of variables, and of snapshots with force records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.session import small_side, written


def align_variables(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Variables that lie in separate tables, as columns of one row per key.

    Only keys that every table has remain; a key that a table has twice is an
    error.  One union and one grouping, so the
    number of shuffles does not grow with the number of variables.
    """
    parts = None
    for name, df in tables.items():
        one = df.select(*keys, F.lit(name).alias("_var"), F.col(name).cast("double").alias("_val"))
        parts = one if parts is None else parts.unionByName(one)
    seen = F.array(*[F.count(F.when(F.col("_var") == name, 1)) for name in tables])
    wide = parts.groupBy(*keys).agg(
        seen.alias("_seen"), *[F.max(F.when(F.col("_var") == name, F.col("_val"))).alias(name) for name in tables]
    )
    twice = F.raise_error(F.lit(f"a variable has two rows for one of the keys {list(keys)}"))
    whole = F.when(F.array_max("_seen") > 1, twice.cast("boolean")).otherwise(F.array_min("_seen") == 1)
    return wide.where(whole).drop("_seen")


def forces_at_snapshots(snapshots: DataFrame, forces: DataFrame, dt: float = 1.0) -> DataFrame:
    """The force row of each snapshot: time equals snapshot times ``dt``.

    Times meet on whole steps, so the join is an equi join."""
    left = snapshots.withColumn("_step", F.col("snapshot").cast("long"))
    right = forces.withColumn("_step", F.round(F.col("time") / F.lit(dt)).cast("long"))
    return left.join(small_side(right), "_step").drop("_step")


def latest_force(snapshots: DataFrame, forces: DataFrame) -> DataFrame:
    """As-of variant: the last force row at or before each snapshot time.

    Both sides are merged, dealt out by ranges of time and written down. The
    last force is carried forward inside a range, and the last one of each range to those
    after it. Of force rows at one time the greatest drag counts; a missing drag is passed over.
    """
    left = snapshots.select(F.col("snapshot").cast("double").alias("time"), F.lit(None).cast("double").alias("drag"), F.lit(1).alias("_kind"))
    right = forces.select(F.col("time").cast("double").alias("time"), F.col("drag").cast("double").alias("drag"), F.lit(0).alias("_kind"))
    # The running number lets snapshots of one time spread over ranges.
    merged = left.unionByName(right).withColumn("_n", F.monotonically_increasing_id())
    order = ["time", "_kind", "drag", "_n"]
    ranged = merged.repartitionByRange(*order).sortWithinPartitions(*order).drop("_n")
    kept = written(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}), "times")
    last = F.max_by("drag", F.when(F.col("drag").isNotNull(), F.col("_at")))
    carried, entries = None, []
    for r in kept.groupBy("_part").agg(last.alias("drag")).orderBy("_part").collect():  # a row for each range
        entries.append((r["_part"], carried))
        carried = carried if r["drag"] is None else r["drag"]
    before = small_side(snapshots.sparkSession.createDataFrame(entries, "_part int, _carried double"))
    inside = F.last("drag", ignorenulls=True).over(Window.partitionBy("_part").orderBy("_at"))
    seen = kept.withColumn("_seen", inside).where(F.col("_kind") == 1).join(before, "_part")
    return seen.select(F.col("time").alias("snapshot"), F.coalesce("_seen", "_carried").alias("drag"))


def gather_points(selection: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coordinates and fields of the selected points."""
    return points.join(small_side(selection.select(*keys)), list(keys))
