"""Sources and sinks, on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.functions.grid import int_div
from cellsift.operators.boxes import first_boxes
from cellsift.operators.draw import draw
from cellsift.operators.windows import first_steps, with_windows
from cellsift.params import CurationParams
from cellsift.plans import fixture_files as files
from cellsift.plans import views
from cellsift.plans.catalog import query, rounded
from cellsift.plans.sqltext import race, with_
from cellsift.plans.views import CLOUD, FIELD, FRAMES
from cellsift.session import scratch_path
from cellsift.sinks import tables as sinks
from cellsift.sources import arrays, formats, listing, openfoam, tabular
from cellsift.sources.rawgrid import read_boxes, read_raw_grid

GRID = views.FRAME_GRID
FLOAT = "CAST(CAST({0} AS FLOAT) AS DOUBLE) AS {0}"


def raw_frames(spark, sf) -> str:
    """Flat grid files, one per frame and variable, x fastest."""
    path = scratch_path(spark, "raw")
    frames = views.frames(spark, sf).withColumn("name", F.format_string("{}_%.6f", F.col("frame") + F.lit(0.5)))
    files.write_grids(frames, path, "name", ["u", "v"], ["gz", "gy", "gx"])
    return files.local_path(path)


def _doubles(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


@query(
    "a01_raw_grid_scan",
    with_(FRAMES) + f"SELECT frame + 0.5::DOUBLE AS timestep, gx, gy, gz, {FLOAT.format('u')}, {FLOAT.format('v')} FROM frames",
)
def raw_grid_scan(spark, sf):
    return _doubles(read_raw_grid(spark, raw_frames(spark, sf), ["u", "v"], GRID), "u", "v")


@query(
    "a02_box_reader",
    with_(FRAMES)
    + f"""SELECT frame + 0.5::DOUBLE AS timestep, gx, gy, gz, {FLOAT.format('u')} FROM frames
WHERE (gx // 5) + 2 * ((gy // 5) + gz // 5) < 2""",
)
def box_reader(spark, sf):
    path = raw_frames(spark, sf)
    times = listing.available_times(listing.list_files(spark, path, "u_*"))
    chosen = first_boxes(times, (2, 1, 2), ["timestep"], 2)
    cells = read_boxes(spark, path, ["u"], GRID, views.BOX, chosen)
    return _doubles(cells.select("timestep", "gx", "gy", "gz", "u"), "u")


@query(
    "a03_variable_directories",
    with_(FRAMES)
    + """SELECT frame AS timestep, gx, gy, gz, CAST(CAST(u AS FLOAT) AS DOUBLE) AS velocity_x,
CAST(CAST(v AS FLOAT) AS DOUBLE) AS velocity_y, CAST(CAST(cell AS FLOAT) AS DOUBLE) AS velocity_z,
CAST(CAST(v AS FLOAT) AS DOUBLE) AS enstrophy FROM frames""",
)
def variable_directories(spark, sf):
    path = scratch_path(spark, "cubes")
    frames = views.frames(spark, sf).withColumn("c", F.col("cell").cast("double"))
    order = ["gz", "gy", "gx"]
    for folder, prefix, cols in (("velocity", "uvw", "u+v+c"), ("enstrophy", "enst", "v")):
        named = frames.withColumn("name", F.concat(F.lit(f"{folder}/cube_{prefix}."), F.col("frame").cast("string")))
        files.write_grids(named, path, "name", [f"{folder}={cols}"], order)
    cubes = read_raw_grid(
        spark, files.local_path(path), ["velocity", "enstrophy"], GRID, layout="var_dir", vectors=["velocity"]
    )
    return _doubles(cubes, "velocity_x", "velocity_y", "velocity_z", "enstrophy")


@query(
    "a04_block_directories",
    """WITH f AS (SELECT o_orderkey // 500 AS frame, o_orderkey % 500 AS cell, o_totalprice AS u FROM orders),
g AS (SELECT frame // 4 AS timestep, frame % 4 AS file_no, cell % 5 AS gx, cell // 5 % 10 AS gz, cell // 50 AS gy, u FROM f)
SELECT timestep, file_no, gx, gy, gz, CAST(CAST(u AS FLOAT) AS DOUBLE) AS enstrophy FROM g
WHERE gy // 5 = file_no // 2 % 2 AND gz // 5 = file_no % 2""",
)
def block_directories(spark, sf):
    path = scratch_path(spark, "blocks")
    frames = views.frames(spark, sf)
    name = F.format_string("%d/cube_enst.%d", int_div("frame", 4), F.pmod("frame", F.lit(4)))
    files.write_grids(frames.withColumn("name", name), path, "name", ["enstrophy=u"], ["cell"])
    cubes = read_raw_grid(
        spark, files.local_path(path), ["enstrophy"], (10, 10, 10), layout="block_dir", blocks=2, sizes=(5, 5, 5)
    )
    return _doubles(cubes, "enstrophy")


@query(
    "a05_openfoam_fields",
    with_(FRAMES)
    + """SELECT (frame + 1) * 100 AS timestep, cell AS point_id, u, v, u AS target_p, v AS target_wz FROM frames""",
)
def openfoam_fields(spark, sf):
    path = scratch_path(spark, "foam")
    frames = views.frames(spark, sf).withColumns({"t": (F.col("frame") + 1) * 100, "c": F.col("cell").cast("double")})
    count = frames.agg(F.max("frame")).first()[0] + 1
    files.write_foam(frames, path, "t", {"p": ["u"], "U": ["u", "v", "c"], "vorticity": ["c", "c", "v"]}, "cell")
    return openfoam.project(openfoam.read_snapshots(spark, path, 100, count), "pwz", 2)


@query(
    "a06_force_log",
    """WITH f AS (SELECT CAST(event_id AS DOUBLE) AS "time", value + CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS drag,
row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)
SELECT "time", round(drag, 6) AS drag FROM f WHERE n % 100 = 0""",
)
def force_log(spark, sf):
    path = scratch_path(spark, "forces")
    cloud = views.cloud(spark, sf)
    line = F.concat_ws("", F.col("point_id").cast("string"), F.lit(" (("), F.col("x0").cast("string"), F.lit(" "), F.col("x1").cast("string"), F.lit(" 0))"))
    cloud.select(line.alias("value")).write.text(path)
    forces = tabular.read_forces(spark, path, 100)
    return forces.select("time", rounded("drag"))


@query(
    "a07_csv_snapshots",
    with_(CLOUD)
    + """SELECT timestep + 1 AS timestep, CAST(point_id AS DOUBLE) AS "X", x1 AS "Y", x0 AS dudx, -x0 AS dudy, x1 AS dvdx, -x1 AS dvdy,
round(x0 - x1, 6) AS "vortZ",
round(ln(CASE WHEN abs(x0 - 50) <= 1e-9 THEN 1e-8 ELSE abs(x0 - 50) END), 6) AS log_tke FROM cloud""",
)
def csv_snapshots(spark, sf):
    read = tabular.read_csv_snapshots(spark, _csv_files(spark, sf))
    return read.withColumns({"vortZ": F.round("vortZ", 6), "log_tke": F.round("log_tke", 6)})


@query(
    "a07_csv_loader",
    with_(CLOUD) + """SELECT timestep + 1 AS timestep, CAST(point_id AS DOUBLE) AS "X", round(x0 - x1, 6) AS "vortZ" FROM cloud WHERE timestep < 12""",
)
def csv_loader(spark, sf):
    """The loader by name takes files 1 to ``num_timesteps``."""
    rows = formats.load(spark, "csv", _csv_files(spark, sf), CurationParams(num_timesteps=12))
    return rows.select("timestep", "X", F.round("vortZ", 6).alias("vortZ"))


def _csv_files(spark, sf) -> str:
    path = scratch_path(spark, "csv")
    rows = views.cloud(spark, sf).select(
        F.lpad((F.col("timestep") + 1).cast("string"), 4, "0").alias("cylinder_t"),
        F.col("point_id").cast("double").alias("X"),
        F.col("x1").alias("Y"),
        F.col("x0").alias("dudx"),
        (-F.col("x0")).alias("dudy"),
        F.col("x1").alias("dvdx"),
        (-F.col("x1")).alias("dvdy"),
        (F.col("x0") - F.col("x1")).alias("vortZ"),
        (F.col("x0") - 50).alias("TKE"),
    )
    rows.repartition("cylinder_t", F.pmod(F.hash("X"), F.lit(8))).write.partitionBy("cylinder_t").option("header", "true").csv(path)
    return path


@query(
    "a08_npz_snapshots",
    with_(FRAMES)
    + "SELECT frame + 0.5::DOUBLE AS timestep, (gx * 5 + gy) * 10 + gz AS point_id, gx, gy, gz, u, v FROM frames",
)
def npz_snapshots(spark, sf):
    path = scratch_path(spark, "npz")
    name = F.format_string("{}_PVsample-nx10ny5nz10_nskip1_t%.6f.npz", F.col("frame") + F.lit(0.5))
    files.write_npz(views.frames(spark, sf).withColumn("name", name), path, "name", ["u", "v"], GRID)
    return arrays.npz_snapshots(spark, path, ["u", "v"])


@query(
    "a09_npy_cloud",
    with_(CLOUD) + "SELECT point_id // 500 AS part, point_id % 500 AS point_id, x0, x1, x0 AS y, x0 AS cv FROM cloud",
)
def npy_cloud(spark, sf):
    path = scratch_path(spark, "npy")
    named = views.cloud(spark, sf).withColumn("name", F.format_string("cloud_%d.npy", int_div("point_id", 500)))
    files.write_npy(named, path, "name", ["x0", "x1"], "point_id")
    rows = arrays.read_npy_cloud(spark, path)
    part = F.regexp_extract("path", r"cloud_(\d+)\.npy", 1).cast("long").alias("part")
    return rows.select(part, "point_id", "x0", "x1", "y", "cv")


@query(
    "a10_strided_slab_scan",
    with_(FRAMES)
    + f"""SELECT frame + 0.5::DOUBLE AS timestep, gx, gy, gz, {FLOAT.format('u')} FROM frames
WHERE gx < 8 AND gx % 3 = 0 AND gy % 2 = 0 AND gz % 4 = 0""",
)
def strided_slab_scan(spark, sf):
    cells = read_raw_grid(spark, raw_frames(spark, sf), ["u"], GRID, skips=(3, 2, 4), pad=2, slab=5)
    return _doubles(cells, "u")


@query(
    "a11_strided_sub_box",
    with_(FRAMES)
    + f"""SELECT frame + 0.5::DOUBLE AS timestep, gx, gy, gz, {FLOAT.format('v')} FROM frames
WHERE gx BETWEEN 1 AND 6 AND (gx - 1) % 2 = 0 AND gy BETWEEN 1 AND 3 AND gz BETWEEN 2 AND 7 AND (gz - 2) % 3 = 0""",
)
def strided_sub_box(spark, sf):
    cells = read_raw_grid(
        spark, raw_frames(spark, sf), ["v"], GRID, offsets=(1, 1, 2), sizes=(3, 3, 2), skips=(2, 1, 3), slab=4
    )
    return _doubles(cells, "v")


@query(
    "a12_times_from_names",
    with_(FRAMES) + "SELECT DISTINCT frame + 0.25::DOUBLE AS timestep FROM frames WHERE cell % 7 <> 0",
)
def times_from_names(spark, sf):
    # Names of cells divisible by seven carry no time and are skipped.
    name = F.when(F.pmod("cell", F.lit(7)) == 0, F.lit("notes.txt")).otherwise(
        F.format_string("/data/u_%.6f", F.col("frame") + F.lit(0.25))
    )
    return listing.available_times(views.frames(spark, sf).select(name.alias("path")))


SIZES = """sizes AS (SELECT frame, 4 * count(*) - CASE WHEN max(u) > 499000 THEN 4 ELSE 0 END AS length FROM frames GROUP BY frame)"""


@query(
    "a13_file_sizes",
    with_(FRAMES, SIZES)
    + """SELECT 'u_' || frame AS path, length, length // 4 AS counted, CAST(500 AS BIGINT) AS expected,
CAST(CASE WHEN length // 4 = 500 THEN 1 ELSE 0 END AS BIGINT) AS ok FROM sizes""",
)
def file_sizes(spark, sf):
    short = F.when(F.max("u") > 499000, 4).otherwise(0)
    sizes = views.frames(spark, sf).groupBy("frame").agg((F.count(F.lit(1)) * 4 - short).alias("length"))
    paths = sizes.select(F.concat(F.lit("u_"), F.col("frame").cast("string")).alias("path"), "length")
    return listing.sizes_checked(paths, 500, fail=False).withColumn("ok", F.col("ok").cast("long"))


@query(
    "a14_energy_snapshot_files",
    """SELECT CAST(user_id % 16 AS VARCHAR) AS node_id, event_type AS phase, event_id + 0.5::DOUBLE AS "timestamp", value AS "CPU",
CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS "Node" FROM events""",
)
def energy_snapshot_files(spark, sf):
    path = scratch_path(spark, "energy")
    rows = views.table(spark, sf, "events").select(
        F.concat_ws("_", F.pmod("user_id", F.lit(16)).cast("string"), F.lit("snapshot"), F.col("event_type")).alias("of"),
        (F.col("event_id") + F.lit(0.5)).alias("timestamp"),
        F.col("event_type").alias("phase"),
        F.col("value").alias("CPU"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("value") * 2).alias("Node"),
    )
    rows.repartition("of", F.pmod("timestamp", F.lit(4.0))).write.partitionBy("of").json(path)
    read = tabular.read_energy_snapshots(spark, path, r"of=([^/]+?)_snapshot_", multi_line=False)
    return read.select("node_id", "phase", "timestamp", "CPU", "Node")


# --- sinks: written, then read back -------------------------------------------


@query("k01_curated_dataset", with_(FIELD) + "SELECT timestep, point_id, gx, gy, gz, u, v FROM field")
def curated_dataset(spark, sf):
    path = scratch_path(spark, "curated")
    sinks.write_curated(views.field(spark, sf).select("timestep", "point_id", "gx", "gy", "gz", "u", "v"), path)
    return spark.read.parquet(path).withColumn("timestep", F.col("timestep").cast("long"))


PICKED = f"""picked AS (SELECT timestep // 2 AS window_id, point_id FROM (
SELECT timestep, point_id, row_number() OVER (PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], 3)}, point_id) AS n
FROM field WHERE timestep % 2 = 0) WHERE n <= 100)"""


@query("k02_selection_table", with_(FIELD, PICKED) + "SELECT window_id, point_id FROM picked")
def selection_table(spark, sf):
    path = scratch_path(spark, "selection")
    first = first_steps(with_windows(views.field(spark, sf), 2), 2)
    sinks.write_selection(draw(first, 100, ["point_id"], ["timestep"], seed=3).select("window_id", "point_id"), path)
    return spark.read.parquet(path).withColumn("window_id", F.col("window_id").cast("long"))


@query(
    "k03_box_table",
    with_(FIELD)
    + """SELECT DISTINCT timestep, gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz FROM field
WHERE gx // 5 + 2 * (gy // 5 + gz // 5) < 3""",
)
def box_table(spark, sf):
    path = scratch_path(spark, "boxes")
    cells = views.field(spark, sf)
    counts = (2, 1, views.depth(cells) // 5)
    sinks.write_boxes(first_boxes(cells, counts, ["timestep"], 3), path)
    return spark.read.parquet(path)


@query(
    "k04_csv_per_timestep",
    with_(FIELD) + "SELECT timestep, w, u, v FROM field",
)
def csv_per_timestep(spark, sf):
    path = scratch_path(spark, "csv-out")
    sinks.write_csv(views.field(spark, sf), path, ["w"], ["u", "v"])
    read = spark.read.schema("w double, u double, v double, timestep long").option("header", "true").csv(path)
    return read.select("timestep", "w", "u", "v")


# Variable w is missing at frames where the rule below drops it.
LONG_FRAMES = """long AS (SELECT frame AS timestep, cell AS point_id, 'u' AS variable, u AS value FROM frames
UNION ALL SELECT frame, cell, 'v', v FROM frames WHERE frame % 4 <> 1)"""


@query(
    "k05_complete_timesteps",
    with_(FRAMES, LONG_FRAMES)
    + """SELECT timestep, point_id, variable, value FROM long WHERE timestep IN
(SELECT timestep FROM long GROUP BY timestep HAVING count(DISTINCT variable) = 2)""",
)
def complete_timestep_export(spark, sf):
    path = scratch_path(spark, "complete")
    sinks.write_complete_samples(_long_frames(spark, sf), path, ["u", "v"])
    return spark.read.parquet(path).withColumn("timestep", F.col("timestep").cast("long"))


@query(
    "k05_incomplete_report",
    with_(FRAMES, LONG_FRAMES)
    + "SELECT timestep, count(DISTINCT variable) AS n_present, 'v' AS missing FROM long GROUP BY timestep HAVING count(DISTINCT variable) < 2",
)
def incomplete_report(spark, sf):
    """What the export leaves out: timesteps, and the variables that they miss."""
    report = sinks.write_complete_samples(_long_frames(spark, sf), scratch_path(spark, "complete"), ["u", "v"])
    return report.select("timestep", "n_present", F.array_join("missing", ",").alias("missing"))


def _long_frames(spark, sf):
    frames = views.frames(spark, sf)
    one = lambda name: frames.select(F.col("frame").alias("timestep"), F.col("cell").alias("point_id"), F.lit(name).alias("variable"), F.col(name).alias("value"))
    return one("u").unionByName(one("v").where(F.pmod("timestep", F.lit(4)) != 1))


@query(
    "k06_first_timestep_export",
    with_(FIELD) + "SELECT point_id, u, v, w FROM field WHERE timestep = (SELECT min(timestep) FROM field)",
)
def first_timestep_export(spark, sf):
    path = scratch_path(spark, "first")
    sinks.write_first_timestep(views.field(spark, sf), path, ["point_id", "u", "v", "w"])
    return spark.read.parquet(path)


@query(
    "k07_downsampled_sets",
    with_(CLOUD)
    + " UNION ALL ".join(
        f"""SELECT CAST({n} AS BIGINT) AS n_samples, timestep, point_id, x0, x1 FROM (
SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], 5)}, point_id) AS n FROM cloud) WHERE n <= {n}"""
        for n in (5, 10)
    ),
)
def downsampled_sets(spark, sf):
    path = scratch_path(spark, "downsampled")
    for n in (5, 10):
        sinks.write_downsampled(draw(views.cloud(spark, sf), n, ["point_id"], ["timestep"], seed=5, short="all"), path, n)
    return spark.read.parquet(path).withColumn("n_samples", F.col("n_samples").cast("long"))


