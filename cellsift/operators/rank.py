"""Exact global ranks without an un-partitioned window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.session import small_side, written

# Fixed value: the running id holds the partition above bit 33.
POSITION_BITS = 33


def global_rank(
    df: DataFrame, order_cols: Sequence[str], group_cols: Sequence[str] = (), out: str = "rank", size: str | None = None
) -> DataFrame:
    """Zero-based rank of each row in its group under ``order_cols``.

    Rows are range-partitioned and sorted once, written down, and numbered by
    their place in the sorted partition plus the rows of earlier partitions.
    Make the order unique (end it with an id): then equal values of a hot key
    spread over partitions too.  ``size`` names a column for the group's count.
    """
    group = list(group_cols)
    order = [*group, *order_cols]
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    kept = written(ordered, "ranked").withColumns(
        {
            "_part": F.shiftright("_at", POSITION_BITS),
            "_pos": F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)),
        }
    )
    pieces = kept.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    # One row per partition and group: at most partitions + groups rows.
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part")
    starts = pieces.withColumns(
        {
            "_before": F.sum("_n").over(earlier) - F.col("_n"),
            "_of": F.sum("_n").over(Window.partitionBy(*(group or [F.lit(0)]))),
        }
    ).drop("_n")
    ranked = kept.join(small_side(starts), ["_part", *group]).withColumn(
        out, F.col("_pos") - F.col("_first") + F.col("_before")
    )
    if size:
        ranked = ranked.withColumn(size, F.col("_of"))
    return ranked.drop("_at", "_part", "_pos", "_first", "_before", "_of")


def stratum(rank, size, n: int):
    """Which of ``n`` near-equal runs of a sorted group a rank falls in: the
    first ``size % n`` runs hold one row more."""
    short = F.floor(size / F.lit(n)).cast("long")
    longer = F.pmod(size, F.lit(n))
    edge = longer * (short + 1)
    in_long = F.floor(rank / (short + 1))
    in_short = longer + F.floor((rank - edge) / F.greatest(short, F.lit(1)))
    return F.when(rank < edge, in_long).otherwise(in_short).cast("long")
