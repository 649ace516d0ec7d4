"""Point samplers.  Each takes and returns a DataFrame and works on every group
(timestep) in the same jobs.  ``SAMPLERS`` maps a name to its function, for use
with ``df.transform(SAMPLERS[name], n, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.functions.keys import uniform_key
from cellsift.operators.cluster import midpoints_of, with_labels
from cellsift.operators.divergence import in_strengths
from cellsift.operators.draw import draw
from cellsift.operators.histogram import axis_limits, cluster_histogram, distributions, phase_bins, pooled_of
from cellsift.operators.hypercube import latin_hypercube
from cellsift.operators.rank import global_rank, stratum
from cellsift.session import settle, small_side, written

#: Rows a task may rank or hold at once.
CHUNK_ROWS = 500_000


def full(df: DataFrame, n: int | None = None, **_) -> DataFrame:
    """Every point."""
    return df


def random(df: DataFrame, n: int, *, id_col: str = "point_id", group_cols: Sequence[str] = ("timestep",), seed: int = 0, **_) -> DataFrame:
    """``n`` points per group, uniformly, without replacement."""
    return draw(df, n, [id_col], group_cols, seed=seed)


def maxent_weights(
    df: DataFrame, cluster_cols: Sequence[str], k: int, group_cols: Sequence[str], bins: int, rounds: int, centres: DataFrame | None
) -> DataFrame:
    """Points with the in-strength of their cluster as ``strength``."""
    if k < 2:
        raise ValueError("maximum-entropy weights need at least two clusters")
    ranges = settle(axis_limits(df, cluster_cols, group_cols))
    if centres is None:
        centres = midpoints_of(ranges, cluster_cols, k, group_cols)
    labelled = with_labels(df, cluster_cols, k, group_cols, rounds, centres)
    hist = cluster_histogram(labelled, cluster_cols, k, bins, group_cols, pooled_of(ranges, cluster_cols, group_cols))
    strengths = in_strengths(distributions(hist, group_cols, normalised=True), group_cols)
    return labelled.join(small_side(strengths), [*group_cols, "label"])


def maxent(
    df: DataFrame,
    n: int,
    *,
    cluster_cols: Sequence[str],
    k: int = 10,
    id_col: str = "point_id",
    group_cols: Sequence[str] = ("timestep",),
    seed: int = 0,
    bins: int = 50,
    rounds: int = 10,
    centres: DataFrame | None = None,
    draw_cols: Sequence[str] = (),
    **_,
) -> DataFrame:
    """``n`` points per group, drawn by the in-strength of their cluster.

    ``draw_cols`` splits a group for the draw only (n per box, for example).
    """
    weighted = maxent_weights(df, cluster_cols, k, group_cols, bins, rounds, centres)
    return draw(weighted, n, [id_col], [*group_cols, *draw_cols], weight="strength", seed=seed)


def phase_space(
    df: DataFrame,
    n: int,
    *,
    feature_cols: Sequence[str],
    id_col: str = "point_id",
    group_cols: Sequence[str] = ("timestep",),
    seed: int = 0,
    bins: int = 10,
    chunk_rows: int = CHUNK_ROWS,
    **_,
) -> DataFrame:
    """Uniform in phase space: ``n`` times a non-empty bin, then a point in it.

    With replacement, so a point may come more than once; ``draw_id`` tells the
    draws apart.  Points of a bin are ordered by a seeded key, and a bin is cut
    into slices of that key, so a draw needs only its slice ranked: a bin with a
    third of all rows is as cheap as any other.
    """
    group = list(group_cols)
    key = uniform_key([*group, id_col], f"order-{seed}")
    narrow = df.select(*dict.fromkeys([*group, id_col, *feature_cols]))
    placed = written(phase_bins(narrow, feature_cols, bins, group).select(*dict.fromkeys([*group, id_col, "bin_id"])), "phase-bins")

    bin_counts = settle(placed.groupBy(*group, "bin_id").agg(F.count(F.lit(1)).alias("_in_bin")))
    sized = bin_counts.withColumn("_slices", F.ceil(F.col("_in_bin") / F.lit(chunk_rows)))
    sliced = placed.join(small_side(sized.select(*group, "bin_id", "_slices")), [*group, "bin_id"]).withColumn(
        "_slice", F.when(F.col("_slices") == 1, F.lit(0).cast("long")).otherwise(F.floor(key * F.col("_slices")))
    )
    counts = sliced.groupBy(*group, "bin_id", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*group, "bin_id").orderBy("_slice")
    counts = settle(counts.withColumn("_upto", F.sum("_n").over(running)))

    # Draws: bin by rank, then a position among the rows of the bin.
    if bin_counts._rows <= CHUNK_ROWS:
        ranked = bin_counts.withColumns(
            {
                "_bin_rank": F.row_number().over(Window.partitionBy(*group).orderBy("bin_id")) - 1,
                "_bins": F.count(F.lit(1)).over(Window.partitionBy(*group)),
            }
        )
    else:
        ranked = global_rank(bin_counts, ["bin_id"], group, "_bin_rank", size="_bins")
    draws = (
        ranked.select(*group, "_bins")
        .distinct()
        .withColumn("draw_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        .withColumn("_bin_rank", F.floor(uniform_key([*group, "draw_id"], f"bin-{seed}") * F.col("_bins")))
        .withColumn("_place", uniform_key([*group, "draw_id"], f"place-{seed}"))
        .drop("_bins")
        .join(ranked.drop("_bins"), [*group, "_bin_rank"])
        .withColumn("_position", F.floor(F.col("_place") * F.col("_in_bin")))
    )
    located = (
        draws.join(counts, [*group, "bin_id"])
        .where((F.col("_position") < F.col("_upto")) & (F.col("_position") >= F.col("_upto") - F.col("_n")))
        .select(*group, "bin_id", "_slice", "draw_id", (F.col("_position") - F.col("_upto") + F.col("_n") + 1).alias("_rank"))
    )
    located = settle(located)
    wanted = small_side(located.select(*group, "bin_id", "_slice").distinct())
    rank = F.row_number().over(Window.partitionBy(*group, "bin_id", "_slice").orderBy("_key", id_col))
    inside = sliced.join(wanted, [*group, "bin_id", "_slice"], "left_semi")
    candidates = inside.withColumn("_key", key).withColumn("_rank", rank)
    picked = candidates.join(small_side(located), [*group, "bin_id", "_slice", "_rank"]).select(*group, id_col, "bin_id", "draw_id")
    return df.join(small_side(picked), [*group, id_col])


def stratified(
    df: DataFrame,
    n: int,
    *,
    feature_cols: Sequence[str],
    id_col: str = "point_id",
    group_cols: Sequence[str] = ("timestep",),
    seed: int = 0,
    **_,
) -> DataFrame:
    """Cut each group, ordered by the first feature, into ``n`` near-equal
    strata and take one uniform pick from each.

    Only the group, the feature and the id are sorted; the picks then fetch
    their rows.
    """
    group = list(group_cols)
    narrow = df.select(*dict.fromkeys([*group, feature_cols[0], id_col]))
    ranked = global_rank(narrow, [feature_cols[0], id_col], group, "_rank", size="_size")
    short = F.when(
        F.col("_size") < n,
        F.raise_error(F.format_string("%d strata were asked of a group of %d rows", F.lit(n), F.col("_size"))).cast("long"),
    )
    placed = ranked.withColumn("stratum", F.coalesce(short, stratum(F.col("_rank"), F.col("_size"), n)))
    key = uniform_key([*group, id_col], f"stratum-{seed}")
    picked = placed.groupBy(*group, "stratum").agg(F.min_by(id_col, key).alias(id_col))
    return df.join(small_side(picked), [*group, id_col])


SAMPLERS = {
    "maxent": maxent,
    "random": random,
    "full": full,
    "uips": phase_space,
    "lhs": latin_hypercube,
    "stratified": stratified,
}

__all__ = [
    "SAMPLERS",
    "full",
    "latin_hypercube",
    "maxent",
    "maxent_weights",
    "phase_space",
    "random",
    "stratified",
]
