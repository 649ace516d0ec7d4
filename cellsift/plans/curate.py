"""The two-stage curation job: choose boxes, sample points, project, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.functions.grid import AXES, box_counts, box_number, local_number, with_grid_coordinates
from cellsift.operators.boxes import cells_of_boxes, select_boxes
from cellsift.operators.cluster import STARTING
from cellsift.operators.samplers import SAMPLERS
from cellsift.operators.windows import apply_selection, first_steps, match_times, rows_at_times, window_steps
from cellsift.params import VECTORS, CurationParams, TargetKind
from cellsift.session import settle, small_side, written
from cellsift.sinks.tables import write_boxes, write_curated, write_selection
from cellsift.sources.rawgrid import grid_times, read_boxes, read_raw_grid


@dataclass
class Curated:
    """Result of a curation job."""

    boxes: DataFrame
    selection: DataFrame
    inputs: DataFrame
    targets: DataFrame


def curate(
    cells: DataFrame,
    params: CurationParams,
    centres: DataFrame | None = None,
    point_centres: DataFrame | None = None,
    times: DataFrame | None = None,
) -> Curated:
    """Choose boxes per timestep and draw points per window.

    ``cells`` has ``timestep, point_id, gx, gy, gz`` and the variables; ``times``
    lists the timesteps if they are known.  Points are drawn at the first step
    of a window and kept for its other steps.  Boxes are those of the window's
    first step, so that a kept point exists in every step.
    """
    steps = settle(window_steps(cells if times is None else times, params.window))
    firsts = settle(first_steps(steps, params.window))
    scored = cells.join(small_side(firsts.select("timestep")), "timestep", "left_semi")
    boxes = settle(select_boxes(scored, params, centres, firsts))
    chosen = _at_every_step(boxes, steps, firsts)
    rows = cells_of_boxes(cells, chosen, params.box, ["timestep"]).join(small_side(steps), "timestep")
    return _sample(boxes, rows, params, point_centres)


def curate_archive(
    spark: SparkSession, path: str, params: CurationParams, layout: str = "flat", centres: DataFrame | None = None, **options
) -> Curated:
    """The same job straight from raw grid files.

    Only the cluster variables are scanned, at the first step of each window
    and at the strides of ``params``; that scan is written down once, because
    clustering reads it several times.  Of all other variables and steps only
    the chosen boxes are read, by seeking to them.  A vector variable becomes
    one column for each component.
    """
    variables, scanned = params.variables, params.cluster_var
    if layout != "flat":
        options.setdefault("vectors", [v for v in variables if v in VECTORS])
    params = params.by_component(options.get("vectors", ()))
    times = settle(grid_times(spark, path, variables, params.grid, layout=layout, **options))
    if params.timesteps is not None:
        requested = spark.createDataFrame([(float(t),) for t in params.timesteps], "requested double")
        times = settle(rows_at_times(times, match_times(requested, times)))
    steps = settle(window_steps(times, params.window))
    firsts = settle(first_steps(steps, params.window))

    scored = None
    if params.hypercubes == "maxent":
        wanted = [r["timestep"] for r in firsts.select("timestep").collect()]  # one value per window
        strides = (params.nxskip, params.nyskip, params.nzskip)
        scan = read_raw_grid(spark, path, scanned, params.grid, layout=layout, skips=strides, pad=params.pad, **options)
        scored = written(scan.where(F.col("timestep").isin(wanted)), "scored-cells")
    boxes = settle(select_boxes(scored, params, centres, firsts))
    chosen = _at_every_step(boxes, steps, firsts)
    cells = read_boxes(spark, path, variables, params.grid, params.box, chosen, layout=layout, **options)
    nx, ny, _ = params.grid
    rows = cells.withColumn("point_id", F.col("gx") + F.lit(nx) * (F.col("gy") + F.lit(ny) * F.col("gz")))
    values = {v: F.col(v).cast("double") for v in params.variables}
    return _sample(boxes, rows.withColumns(values).join(small_side(steps), "timestep"), params, None)


def _at_every_step(boxes: DataFrame, steps: DataFrame, firsts: DataFrame) -> DataFrame:
    """The boxes of a window's first step, for each step of the window."""
    starts = boxes.join(firsts, "timestep").select("window_id", "ix", "iy", "iz")
    return starts.join(steps, "window_id").select("timestep", "ix", "iy", "iz")


def _sample(boxes: DataFrame, rows: DataFrame, params: CurationParams, centres: DataFrame | None) -> Curated:
    """Draw points among the cells of the chosen boxes."""
    numbers = box_number(box_counts(params.grid, params.box, params.pad))
    kept = written(rows.withColumns({"cube_id": numbers, "local_id": local_number(params.box)}), "kept-boxes")

    if params.method == "full":
        selection = first_steps(kept, params.window).select("window_id", "cube_id", "point_id")
        return Curated(boxes, selection, _inputs(kept, params), _targets(kept, kept, params))

    first = first_steps(kept, params.window)
    groups = ["timestep", "cube_id"] if params.per_cube and params.method != "maxent" else ["timestep"]
    # Fewer boxes than asked for may exist, and None asks for all of them.
    per_step = boxes.groupBy("timestep").count().agg(F.max("count")).first()[0] or 0
    n = params.num_samples if params.per_cube else params.num_samples * per_step
    if params.method == "maxent" and centres is None and params.starts in STARTING:
        centres = STARTING[params.starts](first, params.cluster_var, params.num_clusters, ["point_id"], groups, params.seed)
    options = dict(
        feature_cols=list(params.input_vars),
        cluster_cols=list(params.cluster_var),
        k=params.num_clusters,
        rounds=params.kmeans_rounds,
        seed=params.seed,
        group_cols=groups,
        centres=centres,
        draw_cols=["cube_id"] if params.per_cube else [],
    )
    if params.method == "maxent":
        options["bins"] = params.point_bins
    if params.method == "uips":
        options["bins"] = params.phase_bins
    picked = SAMPLERS[params.method](first, n, **options)
    selection = settle(picked.select("window_id", "cube_id", "point_id"))
    # A draw with replacement may pick a point twice; both copies are kept.
    sampled = apply_selection(kept, selection.select("window_id", "point_id"))
    return Curated(boxes, selection, _inputs(sampled, params), _targets(kept, sampled, params))


def _keys(params: CurationParams) -> list[str]:
    return ["timestep", "t_idx", "window_id", "cube_id", "local_id", "point_id", "gx", "gy", "gz"]


def _inputs(rows: DataFrame, params: CurationParams) -> DataFrame:
    return with_grid_coordinates(rows, params).select(*_keys(params), *AXES, *params.input_vars)


def _targets(kept: DataFrame, sampled: DataFrame, params: CurationParams) -> DataFrame:
    outputs = [c for c in params.output_vars]
    if params.target_kind is TargetKind.GLOBAL:
        differ = lambda c: F.raise_error(F.lit(f"{c} is not one value for each timestep"))
        one = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(differ(c).cast("double"))
        return kept.groupBy("timestep").agg(*[one(c).alias(c) for c in outputs])
    rows = kept if params.target_kind is TargetKind.FULL else sampled
    return rows.select(*_keys(params), *outputs)


def write(result: Curated, path: str) -> None:
    """Write the four tables of a job under ``path``."""
    write_boxes(result.boxes, f"{path}/boxes")
    write_selection(result.selection, f"{path}/selection")
    write_curated(result.inputs, f"{path}/inputs")
    write_curated(result.targets, f"{path}/targets")
