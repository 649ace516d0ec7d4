"""Windows, sequences and the curation and training jobs."""

import itertools

import pytest
from pyspark.sql import functions as F

from cellsift.functions import grid
from cellsift.operators import windows
from cellsift.operators.boxes import all_boxes, first_boxes
from cellsift.params import CurationParams, TargetKind
from cellsift.plans.compare import compare_methods
from cellsift.plans.curate import curate, curate_archive, write
from cellsift.plans.fixture_files import write_grids
from cellsift.plans.training import training_job, training_table

BASE = dict(
    nx=10, ny=6, nz=8, nxsl=4, nysl=3, nzsl=4, pad=2, cluster_var=("pv",), input_vars=("u", "v"), output_vars=("w",),
    num_clusters=3, kmeans_rounds=2, num_samples=5, num_hypercubes=3, target="p",
)


@pytest.mark.parametrize("box,point", list(itertools.product(("random", "uniform", "maxent"), ("random", "maxent", "uips", "lhs", "stratified"))))
def test_two_stage_job(spark, grid_cells, box, point, tmp_path):
    p = CurationParams(**BASE, hypercubes=box, method=point)
    result = curate(grid_cells, p)
    per_step = result.inputs.groupBy("timestep").count().toPandas()
    assert len(per_step) == 4
    if point != "uips":
        assert (per_step["count"] == 15).all()
    rows = result.inputs.toPandas()
    assert rows.gx.max() < 8  # the padding is never in a complete box
    chosen = {(r.timestep, r.box_no) for r in result.boxes.collect()}
    assert all((w * 2, c) in chosen for w, c in zip(rows.window_id, rows.cube_id))
    first, second = (set(rows[rows.timestep == t].point_id) for t in (0, 1))
    assert first == second
    assert (rows.u.round(6) == (rows.gz * 1000 + rows.gy * 10 + rows.gx + rows.timestep * 0.1).round(6)).all()
    if (box, point) == ("maxent", "maxent"):
        write(result, str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out" / "targets")).count() == 60
        again = curate(grid_cells.repartition(11), p).inputs.toPandas()
        assert set(zip(again.timestep, again.point_id)) == set(zip(rows.timestep, rows.point_id))


def test_per_cube_full_and_global(grid_cells):
    p = CurationParams(**{**BASE, "hypercubes": "uniform", "method": "maxent", "per_cube": True})
    rows = curate(grid_cells, p).inputs.groupBy("timestep", "cube_id").count().toPandas()
    assert (rows["count"] == 5).all() and len(rows) == 12
    full = curate(grid_cells, CurationParams(**{**BASE, "method": "full", "target": "p_full"}))
    assert full.inputs.count() == full.targets.count() == 4 * 3 * 48
    drag = curate(grid_cells, CurationParams(**{**BASE, "method": "random", "target": "drag"}))
    assert drag.targets.count() == 4


def test_parameters_are_checked():
    assert CurationParams().target_kind is TargetKind.LOCAL
    assert CurationParams(target="drag").target_kind is TargetKind.GLOBAL
    for wrong in (dict(method="best"), dict(overlap=2, window=2), dict(hypercubes="x"), dict(xscaler="y")):
        with pytest.raises(ValueError):
            CurationParams(**wrong)


def test_incomplete_boxes_and_short_lists(grid_cells):
    counts = grid.box_counts((10, 6, 8), (4, 4, 3), 2)
    assert counts == (2, 1, 2)
    kept = grid.complete_boxes(grid_cells, (10, 6, 8), (4, 4, 3), 2).agg(F.max("gx"), F.max("gy"), F.max("gz")).first()
    assert tuple(kept) == (7, 3, 5)
    assert first_boxes(grid_cells, counts, ["timestep"], 99).count() == all_boxes(grid_cells, counts, ["timestep"]).count() == 16
    order = [r["box_no"] for r in first_boxes(grid_cells, counts, ["timestep"], 3).where("timestep = 0").collect()]
    assert sorted(order) == [0, 1, 2]


def test_windows_drop_the_tail(grid_cells):
    kept = windows.with_windows(grid_cells, 3).select("timestep", "window_id").distinct().collect()
    assert sorted((r[0], r[1]) for r in kept) == [(0, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize("window,overlap", [(2, 1), (3, 1), (3, 0), (4, 2), (5, 1)])
def test_sequences(spark, window, overlap):
    nt = 9
    df = spark.range(nt).select((F.col("id") * 10).alias("timestep"), F.explode(F.array(F.lit(1), F.lit(2))).alias("cube_id"))
    got = sorted((r["cube_id"], r["start"], r["step"], r["timestep"]) for r in windows.sequences(df, window, overlap).collect())
    stride = window - overlap
    want = sorted(
        (c, s, k, (s * stride + k) * 10) for c in (1, 2) for s in range((nt - window) // stride + 1) for k in range(window)
    )
    assert got == want
    with pytest.raises(ValueError):
        windows.sequences(df, 2, 2)


def test_times_match_within_the_tolerance(spark):
    have = spark.createDataFrame([(1.0,), (2.0,), (28.04,)], "timestep double")
    want = spark.createDataFrame([(1.0000005,), (2.000002,), (28.04,)], "requested double")
    got = {r["requested"]: r["timestep"] for r in windows.match_times(want, have).collect()}
    assert got == {1.0000005: 1.0, 2.000002: None, 28.04: 28.04}


def test_complete_and_incomplete_timesteps(spark):
    df = spark.createDataFrame([(0, "u"), (0, "w"), (1, "u"), (2, "w"), (2, "u"), (2, "q")], "timestep long, variable string")
    assert {r[0] for r in windows.complete_timesteps(df, ["u", "w"]).select("timestep").collect()} == {0, 2}
    assert [tuple(r) for r in windows.incomplete_timesteps(df, ["u", "w"]).collect()] == [(1, 1)]


def test_training_table(grid_cells):
    cells = grid.with_box(grid_cells, (5, 3, 4)).withColumn("cube_id", grid.box_number((2, 2, 2)))
    table = training_table(cells, ["u", "v"], ["w"], 2, 1, 0.25)
    parts = table.rows.select("cube_id", "start", "split").distinct().groupBy("split").count().toPandas().set_index("split")["count"]
    assert parts["test"] == 6 and parts["train"] == 18
    train = table.rows.where("split = 'train'").agg(F.min("u"), F.max("u"), F.avg("w"), F.stddev_pop("w")).first()
    assert train[0] == pytest.approx(0) and train[1] == pytest.approx(1) and train[2] == pytest.approx(0, abs=1e-9) and train[3] == pytest.approx(1)
    sizes = {r[0] for r in table.packed.select(F.size("u")).collect()}
    assert sizes == {2 * 60}
    shuffled = training_table(cells, ["u"], ["w"], 2, 1, 0.25, "PowerTransformer", "None", shuffle=True, seed=3)
    assert shuffled.rows.select("cube_id", "start", "split").distinct().where("split = 'test'").count() == 6


def test_methods_side_by_side(grid_cells):
    hist, kde = compare_methods(grid_cells, 40, "pv", 11, timestep=1, feature_cols=["u", "v"], k=3, rounds=1)
    assert {r[0] for r in hist.select("method").distinct().collect()} == {"full", "random", "uips", "maxent"}
    assert hist.count() == 4 * 10 and kde.count() == 4 * 11


@pytest.mark.parametrize("box,point", [("maxent", "maxent"), ("random", "random")])
def test_archive_job_equals_the_table_job(spark, grid_cells, tmp_path, box, point):
    values = {c: F.col(c).cast("float") for c in ("u", "v", "w", "pv")}
    cells = grid_cells.withColumns({**values, "timestep": F.col("timestep") + F.lit(0.5)})
    named = cells.withColumn("name", F.format_string("{}_%.6f", F.col("timestep")))
    write_grids(named, str(tmp_path), "name", ["u", "v", "w", "pv"], ["gz", "gy", "gx"])
    p = CurationParams(**BASE, hypercubes=box, method=point)
    doubles = cells.withColumns({c: F.col(c).cast("double") for c in values})
    key = lambda df: sorted(map(tuple, df.select("timestep", "cube_id", "local_id", "point_id", "u", "v").collect()))
    from_files = curate_archive(spark, str(tmp_path), p, slab=3)
    assert key(from_files.inputs) == key(curate(doubles, p).inputs)
    strided = CurationParams(**{**BASE, "nxskip": 2, "nyskip": 3, "nzskip": 2, "timesteps": (0.5, 1.5)}, hypercubes=box, method=point)
    few = curate_archive(spark, str(tmp_path), strided)
    assert few.inputs.count() == 30 and {r[0] for r in few.boxes.select("timestep").distinct().collect()} == {0.5}


@pytest.mark.parametrize("method,target", [("random", "p"), ("uips", "p"), ("random", "p_full"), ("random", "drag"), ("full", "p_full")])
def test_training_by_parameters(grid_cells, method, target):
    import numpy as np

    p = CurationParams(**{**BASE, "hypercubes": "uniform", "method": method, "target": target, "output_vars": ("u",)}, test_frac=0.25, yscaler="None")
    cells = grid_cells.withColumn("u", F.col("timestep") * 2.0) if target == "drag" else grid_cells
    result = curate(cells, p)
    job = training_job(result, p)
    packed = job.packed.toPandas()
    assert len(packed) == 9 and (packed.split == "test").sum() == 3  # three boxes, starts 0 to 2
    drawn, given = result.inputs.toPandas(), result.targets.toPandas()
    for r in packed.itertuples():
        cube, start = map(int, r.seq_id.split(":"))
        here = drawn[(drawn.cube_id == cube) & drawn.timestep.between(start, start + 1)]
        assert len(r.u) == len(here)
        of = given if target == "drag" else given[given.cube_id == cube]
        want = of[of.timestep.between(start, start + 1)]
        want = want.sort_values("timestep" if target == "drag" else ["timestep", "point_id"]).u
        assert np.allclose(r.target_u, want)
    train = np.concatenate(packed[packed.split == "train"].v.tolist())
    assert train.min() == 0 and train.max() == 1
