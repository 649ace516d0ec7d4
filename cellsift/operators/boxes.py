"""Selection of boxes ("hypercubes") per timestep, and of the cells in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.functions.bins import bin_index
from cellsift.functions.grid import box_counts, box_number, box_from_number, complete_boxes, with_box
from cellsift.operators.cluster import STARTING, assign, lloyd, midpoints_of
from cellsift.operators.draw import draw
from cellsift.operators.histogram import axis_limits, counts_with_zeros, distributions, pooled, pooled_limits, pooled_of
from cellsift.operators.divergence import out_strengths
from cellsift.session import settle, small_side, written

BOX_COLS = ("ix", "iy", "iz")


def _below(n: int):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def all_boxes(groups: DataFrame, counts: tuple[int, int, int], group_cols: Sequence[str]) -> DataFrame:
    """Every complete box of the grid for every group, without a look at cells.

    Layers of boxes are spread over tasks first; each task lists its layers.
    """
    num_x, num_y, num_z = counts
    if min(counts) == 0:
        return groups.select(*group_cols).limit(0).withColumns({c: F.lit(0).cast("long") for c in ("box_no", *BOX_COLS)})
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    layers = groups.select(*group_cols).distinct().withColumn("iz", _below(num_z)).repartition(tasks, *group_cols, "iz")
    numbered = layers.withColumn("_in_layer", _below(num_x * num_y))
    return numbered.withColumn("box_no", F.col("_in_layer") + F.lit(num_x * num_y) * F.col("iz")).select(
        *group_cols, "box_no", *[c.alias(n) for n, c in box_from_number("box_no", counts).items()]
    )


def first_boxes(groups: DataFrame, counts: tuple[int, int, int], group_cols: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` boxes in x-fastest order; all of them when ``n`` is null
    or larger than their number.  Only the wanted boxes are listed."""
    total = counts[0] * counts[1] * counts[2]
    if n is None or n >= total:
        return all_boxes(groups, counts, group_cols)
    numbered = groups.select(*group_cols).distinct().withColumn("box_no", _below(n))
    return numbered.select(*group_cols, "box_no", *[c.alias(m) for m, c in box_from_number("box_no", counts).items()])


def random_boxes(boxes: DataFrame, n: int | None, group_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` boxes per group without replacement."""
    if n is None:
        return boxes
    return draw(boxes, n, ["box_no"], group_cols, seed=f"box-{seed}", short="all")


def box_label_bins(
    cells: DataFrame,
    cols: Sequence[str],
    centres: DataFrame,
    k: int,
    bins: int,
    box: tuple[int, int, int],
    group_cols: Sequence[str],
    limits: DataFrame | None = None,
) -> DataFrame:
    """Counts per (group, box, label, bin) of the pooled cluster variables.

    The one pass over all cells that box scoring needs after clustering: the
    cluster histogram and the box totals are both sums of this table, which is
    written down because it is read twice.
    """
    if limits is None:
        limits = pooled_limits(cells, cols, group_cols)
    labelled = assign(with_box(cells, box), cols, centres, k, group_cols)
    values = pooled(labelled.join(small_side(limits), list(group_cols)), cols)
    binned = values.withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
    counts = binned.groupBy(*group_cols, *BOX_COLS, "label", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    return written(counts, "box-label-bins")


def histogram_of_boxes(counts: DataFrame, k: int, bins: int, group_cols: Sequence[str]) -> DataFrame:
    """Cluster histogram from the per-box counts."""
    merged = counts.groupBy(*group_cols, "label", "bin").agg(F.sum("cnt").alias("cnt"))
    return counts_with_zeros(merged, bins, group_cols, k)


def box_totals(counts: DataFrame, strengths: DataFrame, n_cols: int, group_cols: Sequence[str]) -> DataFrame:
    """Sum of the strengths of a box's cells.  A cell counts once, although it
    gave ``n_cols`` values."""
    per_label = counts.groupBy(*group_cols, *BOX_COLS, "label").agg((F.sum("cnt") / n_cols).alias("_cells"))
    return (
        per_label.join(small_side(strengths), [*group_cols, "label"])
        .groupBy(*group_cols, *BOX_COLS)
        .agg(F.sum(F.col("_cells") * F.col("strength")).alias("total"))
    )


def score_boxes(
    cells: DataFrame,
    cols: Sequence[str],
    k: int,
    box: tuple[int, int, int],
    group_cols: Sequence[str],
    bins: int = 10,
    rounds: int = 10,
    centres: DataFrame | None = None,
) -> DataFrame:
    """Total out-strength of every box that holds cells.

    Scans: one for the ranges, one per k-means round, one for the counts.
    """
    ranges = settle(axis_limits(cells, cols, group_cols))
    if centres is None:
        centres = midpoints_of(ranges, cols, k, group_cols)
    centres = lloyd(cells, cols, k, group_cols, rounds, centres)
    counts = box_label_bins(cells, cols, centres, k, bins, box, group_cols, pooled_of(ranges, cols, group_cols))
    dists = distributions(histogram_of_boxes(counts, k, bins, group_cols), group_cols, normalised=True)
    return box_totals(counts, out_strengths(dists, group_cols), len(cols), group_cols)


def draw_scored(totals: DataFrame, n: int | None, group_cols: Sequence[str], seed: int = 0, weight: str = "total") -> DataFrame:
    """``n`` boxes per group drawn by their total; a group whose totals are all
    zero is drawn uniformly, and a group with fewer boxes is kept whole."""
    if n is None:
        return totals
    group = list(group_cols)
    sums = totals.groupBy(*group).agg(
        F.sum(weight).alias("_mass"), F.count(F.lit(1)).alias("_boxes"), F.count(F.when(F.col(weight) > 0, 1)).alias("_live")
    )
    too_few = (F.col("_mass") > 0) & (F.col("_live") < n) & (F.col("_boxes") > n)
    guard = F.when(too_few, F.raise_error(F.lit("fewer boxes with a positive total than boxes asked for")).cast("double"))
    joined = totals.join(small_side(sums), group)
    joined = joined.withColumn(
        "_w",
        F.coalesce(
            guard, F.when((F.col("_mass") > 0) & (F.col("_boxes") > n), F.col(weight).cast("double")).otherwise(F.lit(1.0))
        ),
    )
    return draw(joined, n, BOX_COLS, group, weight="_w", seed=f"box-{seed}", short="all").drop("_mass", "_boxes", "_live", "_w")


def select_boxes(cells: DataFrame, params, centres: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Chosen boxes per timestep: group columns, ``ix, iy, iz`` and ``box_no``.

    ``groups`` lists the timesteps if they are known; the cells are then read
    for the maximum-entropy method only.
    """
    group = list(params.group_cols)
    counts = box_counts(params.grid, params.box, params.pad)
    n = params.num_hypercubes
    if params.hypercubes == "maxent":
        whole = complete_boxes(cells, params.grid, params.box, params.pad)
        if centres is None and params.starts in STARTING:
            centres = STARTING[params.starts](whole, params.cluster_var, params.num_clusters, ["gx", "gy", "gz"], group, params.seed)
        totals = score_boxes(
            whole, params.cluster_var, params.num_clusters, params.box, group, params.box_bins, params.kmeans_rounds, centres
        )
        chosen = draw_scored(totals, n, group, params.seed)
        return chosen.select(*group, *BOX_COLS, box_number(counts).alias("box_no"))
    groups = cells if groups is None else groups
    if params.hypercubes == "uniform":
        return first_boxes(groups, counts, group, n)
    return random_boxes(all_boxes(groups, counts, group), n, group, params.seed)


def cells_of_boxes(cells: DataFrame, chosen: DataFrame, box: tuple[int, int, int], group_cols: Sequence[str]) -> DataFrame:
    """Cells of the chosen boxes: a semi join against the small box table."""
    keys = [*group_cols, *BOX_COLS]
    return with_box(cells, box).join(small_side(chosen.select(*keys)), keys, "left_semi")


def top_boxes(totals: DataFrame, n: int, group_cols: Sequence[str]) -> DataFrame:
    """The ``n`` boxes with the largest totals in each group."""
    order = Window.partitionBy(*group_cols).orderBy(F.desc("total"), *BOX_COLS)
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
