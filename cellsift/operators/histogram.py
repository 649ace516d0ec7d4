"""Grouped histograms and the distributions made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.functions.bins import bin_index, bin_key
from cellsift.session import settle, small_side

# Fixed value: added to every probability before a logarithm is taken.
EPSILON = 1e-10


def pooled_limits(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str]) -> DataFrame:
    """Smallest and largest value over all ``cols`` together, per group."""
    low = F.least(*cols) if len(cols) > 1 else F.col(cols[0])
    high = F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])
    return df.groupBy(*group_cols).agg(F.min(low).alias("lo"), F.max(high).alias("hi"))


def pooled_of(ranges: DataFrame, cols: Sequence[str], group_cols: Sequence[str]) -> DataFrame:
    """Pooled limits from the limits of each column, without another scan."""
    low, high = [F.col(f"lo_{c}") for c in cols], [F.col(f"hi_{c}") for c in cols]
    one = len(cols) == 1
    return ranges.select(
        *group_cols, (low[0] if one else F.least(*low)).alias("lo"), (high[0] if one else F.greatest(*high)).alias("hi")
    )


def axis_limits(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str]) -> DataFrame:
    """``lo_<col>``, ``hi_<col>`` of each column, per group."""
    aggs = [f(c).alias(f"{p}_{c}") for c in cols for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return df.groupBy(*group_cols).agg(*aggs)


def pooled(df: DataFrame, cols: Sequence[str], out: str = "value") -> DataFrame:
    """One row per value of ``cols``; no copy is made for a single column."""
    if len(cols) == 1:
        return df.withColumn(out, F.col(cols[0]))
    return df.withColumn(out, F.explode(F.array(*cols)))


def with_bin(df: DataFrame, cols: Sequence[str], bins: int, group_cols: Sequence[str], limits: DataFrame | None = None) -> DataFrame:
    """Each pooled value with its ``bin`` over the shared range of its group."""
    if limits is None:
        limits = pooled_limits(df, cols, group_cols)
    joined = df.join(small_side(limits), list(group_cols))
    values = pooled(joined, cols)
    return values.withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins)).drop("lo", "hi", "value")


def counts_with_zeros(counts: DataFrame, bins: int, group_cols: Sequence[str], labels: int | None = None) -> DataFrame:
    """Fill a (group, label, bin) count table with the empty bins.

    The counts of a group, labels x bins numbers at most, are brought together
    once.  Everything computed from them per label or per bin afterwards is
    partitioned by the group already and needs no further shuffle.
    """
    cells = bins * (labels or 1)
    place = F.col("bin") if labels is None else F.col("label") * F.lit(bins) + F.col("bin")
    packed = counts.groupBy(*group_cols).agg(
        F.map_from_entries(F.collect_list(F.struct(place.cast("long"), F.col("cnt")))).alias("_cnt")
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
    full = packed.withColumn("_at", every).withColumn("cnt", F.coalesce(F.try_element_at("_cnt", F.col("_at")), F.lit(0)))
    columns = {"bin": F.pmod("_at", F.lit(bins))}
    if labels is not None:
        columns["label"] = F.floor(F.col("_at") / F.lit(bins)).cast("long")
    return full.withColumns(columns).select(*group_cols, *(["label"] if labels is not None else []), "bin", "cnt")


def cluster_histogram(
    labelled: DataFrame, cols: Sequence[str], labels: int, bins: int, group_cols: Sequence[str], limits: DataFrame | None = None
) -> DataFrame:
    """Counts per group, label and bin over one shared range, zeros included.

    Map-side partial counts are merged by the shuffle: the local and the global
    histogram of a distributed run in one ``groupBy``.
    """
    binned = with_bin(labelled, cols, bins, group_cols, limits)
    counts = binned.groupBy(*group_cols, "label", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    return counts_with_zeros(counts, bins, group_cols, labels)


def distributions(hist: DataFrame, group_cols: Sequence[str], normalised: bool = False) -> DataFrame:
    """Counts to probabilities plus a small constant; an empty cluster keeps
    zeros.  ``normalised`` divides by the new total, as relative entropy does.

    ``hist`` is small: groups x labels x bins rows.
    """
    label = Window.partitionBy(*group_cols, "label")
    total = F.sum("cnt").over(label)
    share = F.when(total > 0, F.col("cnt") / total).otherwise(F.lit(0.0)) + F.lit(EPSILON)
    if normalised:
        mass = F.when(total > 0, F.lit(1.0)).otherwise(F.lit(0.0)) + F.count(F.lit(1)).over(label) * F.lit(EPSILON)
        share = share / mass
    return hist.withColumn("p", share)


def phase_bins(df: DataFrame, cols: Sequence[str], bins: int, group_cols: Sequence[str], out: str = "bin_id") -> DataFrame:
    """Each row with its bin in the space of ``cols``: a flat id, or in many
    dimensions the array of the bins along each axis. Only bins that hold rows occur."""
    limits = axis_limits(df, cols, group_cols)
    joined = df.join(small_side(limits), list(group_cols))
    axis = [bin_index(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins) for c in cols]
    return joined.withColumn(out, bin_key(axis, bins)).drop(*[f"{p}_{c}" for c in cols for p in ("lo", "hi")])


def phase_histogram(df: DataFrame, cols: Sequence[str], bins: int, group_cols: Sequence[str]) -> DataFrame:
    """Counts of the non-empty bins in the space of ``cols``."""
    return phase_bins(df, cols, bins, group_cols).groupBy(*group_cols, "bin_id").agg(F.count(F.lit(1)).alias("cnt"))


def density_histogram(df: DataFrame, col: str, edges: int, group_cols: Sequence[str]) -> DataFrame:
    """Density per bin from ``edges`` evenly spaced edges, that is edges - 1
    bins; counts times width add up to one."""
    bins = edges - 1
    limits = settle(pooled_limits(df, [col], group_cols))
    counts = with_bin(df, [col], bins, group_cols, limits).groupBy(*group_cols, "bin").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    full = counts_with_zeros(counts, bins, group_cols)
    total = F.sum("cnt").over(Window.partitionBy(*group_cols))
    span = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    width = span / F.lit(bins)
    return (
        full.withColumn("_n", total)
        .join(limits, list(group_cols))
        .withColumn("density", F.col("cnt") / (F.col("_n") * width))
        .withColumn("area", F.col("cnt") / F.col("_n"))
        .drop("_n", "lo", "hi")
    )


def cluster_sizes(labelled: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*group_cols, "label").agg(F.count(F.lit(1)).alias("cnt"))


def shared_bin_probabilities(tagged: DataFrame, col: str, bins: int, tag: str, group_cols: Sequence[str], limits: DataFrame) -> DataFrame:
    """Probability per bin of several row sets over one range per group."""
    keys = [*group_cols, tag]
    counts = with_bin(tagged, [col], bins, group_cols, limits).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    full = counts_with_zeros(counts, bins, keys)
    return full.withColumn("p", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(*keys))).drop("cnt")


def column_histograms(df: DataFrame, cols: Sequence[str], bins: int, split_col: str) -> DataFrame:
    """Histogram of each column in each part of a split, each over its own range."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(split_col, F.explode(entries).alias("e")).select(split_col, "e.column", "e.value")
    keys = [split_col, "column"]
    counts = with_bin(long, ["value"], bins, keys).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("cnt"))
    return counts_with_zeros(counts, bins, keys)
