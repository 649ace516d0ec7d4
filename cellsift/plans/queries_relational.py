"""Projections, filters, joins, windows, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.functions import grid, scalars
from cellsift.functions.bins import bin_index, flat_bin
from cellsift.functions.grid import int_div
from cellsift.operators import boxes, windows
from cellsift.operators.cluster import assign, midpoint_centres, sort_centres
from cellsift.operators.divergence import in_strengths, kl_term
from cellsift.operators.draw import draw, not_yet_chosen
from cellsift.operators.energy import intervals
from cellsift.operators.histogram import axis_limits, cluster_histogram, distributions, pooled_limits
from cellsift.operators.joins import align_variables, forces_at_snapshots, gather_points, latest_force
from cellsift.operators.rank import global_rank, stratum
from cellsift.operators.samplers import latin_hypercube
from cellsift.operators.windows import match_times
from cellsift.params import CurationParams, TargetKind
from cellsift.plans import views
from cellsift.plans.catalog import query, rounded
from cellsift.plans.sqltext import bin_of, cluster_hist, key, kl, labelled, midpoints, probabilities, race, with_
from cellsift.plans.views import CLOUD, DOCS, FIELD, FRAMES, LINE_ITEMS, SNAPSHOTS, VECTORS
from cellsift.session import small_side

TS = ["timestep"]
BOX = views.BOX
CENTRES = midpoints("field", ["u"], 4)
LABELS = labelled("field", ["u"], 4)


def _labelled_field(spark, sf):
    cells = views.field(spark, sf)
    return assign(cells, ["u"], midpoint_centres(cells, ["u"], 4, TS), 4, TS)


# --- projections, filters, predicates -----------------------------------------


@query("b01_variable_roles", with_(FIELD) + "SELECT timestep, point_id, u AS x_u, v AS x_v, w AS y_w, u AS cv_u FROM field")
def variable_roles(spark, sf):
    f = views.field(spark, sf)
    role = lambda prefix, names: [F.col(n).alias(f"{prefix}_{n}") for n in names]
    return f.select("timestep", "point_id", *role("x", ["u", "v"]), *role("y", ["w"]), *role("cv", ["u"]))


@query(
    "b02_requested_timesteps",
    with_(FIELD) + "SELECT timestep, point_id, u FROM field WHERE timestep IN (1, 4)",
)
def requested_timesteps(spark, sf):
    f = views.field(spark, sf).select(F.col("timestep").cast("double"), "point_id", "u")
    wanted = spark.createDataFrame([(4.0000005,), (1.0,), (2.000002,)], "requested double")
    rows = windows.rows_at_times(f, match_times(wanted, f.select("timestep").distinct()))
    return rows.withColumn("timestep", F.col("timestep").cast("long")).select("timestep", "point_id", "u")


@query("b02_requested_timesteps_integer", with_(FIELD) + "SELECT timestep, point_id, u FROM field WHERE timestep IN (0, 3)")
def requested_timesteps_integer(spark, sf):
    return views.field(spark, sf).where(F.col("timestep").isin(3, 0, 99)).select("timestep", "point_id", "u")


@query(
    "b03_stride_filter",
    with_(FIELD) + "SELECT timestep, point_id, gx, gy, gz FROM field WHERE gx >= 1 AND (gx - 1) % 3 = 0 AND gy % 2 = 0 AND gz % 2 = 0",
)
def stride_filter(spark, sf):
    return grid.strided(views.field(spark, sf), (3, 2, 2), (1, 0, 0)).select("timestep", "point_id", "gx", "gy", "gz")


@query(
    "b04_box_crop",
    with_(FIELD) + "SELECT timestep, point_id, u FROM field WHERE gx BETWEEN 2 AND 6 AND gy BETWEEN 1 AND 3 AND gz BETWEEN 1 AND 4",
)
def box_crop(spark, sf):
    return grid.cropped(views.field(spark, sf), (2, 1, 1), (5, 3, 4)).select("timestep", "point_id", "u")


@query("b05_padding_dropped", with_(FIELD) + "SELECT timestep, point_id, gx, u FROM field WHERE gx < 8")
def padding_dropped(spark, sf):
    return grid.without_padding(views.field(spark, sf), views.NX, 2).select("timestep", "point_id", "gx", "u")


@query("b06_yz_plane", with_(FIELD) + "SELECT gy, gz, v FROM field WHERE timestep = 2 AND gx = 3")
def yz_plane(spark, sf):
    return grid.yz_plane(views.field(spark, sf), 2, 3, "v")


@query(
    "b07_vector_components",
    "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS vx, CAST(embedding[2] AS DOUBLE) AS vy, CAST(embedding[3] AS DOUBLE) AS vz FROM embeddings",
)
def vector_components(spark, sf):
    parts = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("vx", "vy", "vz"))]
    return views.table(spark, sf, "embeddings").select("vec_id", *parts)


@query(
    "b08_target_and_dims",
    with_(FIELD) + "SELECT timestep, point_id, u, v, u AS target_p, w AS target_wz FROM field",
)
def target_and_dims(spark, sf):
    from cellsift.sources.openfoam import project

    f = views.field(spark, sf).withColumns({"p": F.col("u"), "wz": F.col("w")})
    return project(f, "pwz", 2)


@query(
    "b09_target_kinds",
    with_(
        FIELD,
        f"""picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], 9)}, point_id) AS n
FROM field WHERE timestep % 2 = 0) WHERE n <= 40)""",
    )
    + """SELECT 'global' AS kind, f.timestep, CAST(NULL AS BIGINT) AS point_id, min(w) AS target FROM field f GROUP BY f.timestep
UNION ALL SELECT 'local', f.timestep, f.point_id, f.w FROM field f JOIN picked p ON p.point_id = f.point_id AND p.timestep // 2 = f.timestep // 2
UNION ALL SELECT 'full', timestep, point_id, w FROM field""",
)
def target_kinds(spark, sf):
    stepped = windows.with_windows(views.field(spark, sf), 2)
    chosen = draw(windows.first_steps(stepped, 2), 40, ["point_id"], TS, seed=9).select("window_id", "point_id")
    sampled = windows.apply_selection(stepped, chosen)
    out = None
    for kind in TargetKind:
        part = windows.project_target(stepped, sampled, ["w"], kind)
        if "point_id" not in part.columns:
            part = part.withColumn("point_id", F.lit(None).cast("long"))
        part = part.select(F.lit(kind.value).alias("kind"), "timestep", "point_id", F.col("w").alias("target"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "b10_complete_boxes",
    with_(FIELD) + "SELECT timestep, point_id, gx // 4 AS ix, gy // 2 AS iy, gz // 4 AS iz FROM field "
    "WHERE gx < 8 AND gy < 4 AND gz < (SELECT max(gz) + 1 FROM field) // 4 * 4",
)
def complete_boxes(spark, sf):
    f = views.field(spark, sf)
    shape = (views.NX, views.NY, views.depth(f))
    kept = grid.complete_boxes(f, shape, (4, 2, 4), pad=1)
    return grid.with_box(kept, (4, 2, 4)).select("timestep", "point_id", "ix", "iy", "iz")


@query("b11_near_zero_filter", with_(CLOUD) + "SELECT point_id, x0 FROM cloud WHERE abs(x0) > 0.5")
def near_zero_filter(spark, sf):
    return scalars.near_zero_filter(views.cloud(spark, sf), "x0", 0.5).select("point_id", "x0")


# --- joins --------------------------------------------------------------------


@query(
    "c01_variables_aligned",
    with_(FIELD)
    + """SELECT timestep, gx, gy, gz, a.u, b.v, c.w FROM (SELECT * FROM field) a JOIN (SELECT timestep, gx, gy, gz, v FROM field WHERE v > 20) b
USING (timestep, gx, gy, gz) JOIN (SELECT timestep, gx, gy, gz, w FROM field) c USING (timestep, gx, gy, gz)""",
)
def variables_aligned(spark, sf):
    f = views.field(spark, sf)
    keys = ["timestep", "gx", "gy", "gz"]
    return align_variables({"u": f, "v": f.where(F.col("v") > 20), "w": f}, keys)


@query(
    "c02_cells_of_boxes",
    with_(FIELD)
    + """SELECT timestep, point_id, gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz, u FROM field WHERE gx // 5 + 2 * (gy // 5 + gz // 5) < 2""",
)
def cells_of_boxes(spark, sf):
    f = views.field(spark, sf)
    chosen = boxes.first_boxes(f, (2, 1, views.depth(f) // 5), TS, 2)
    return boxes.cells_of_boxes(f, chosen, BOX, TS).select("timestep", "point_id", "ix", "iy", "iz", "u")


@query(
    "c03_selection_per_window",
    with_(
        FIELD,
        f"""picked AS (SELECT timestep // 2 AS window_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY timestep
ORDER BY {race(['timestep', 'point_id'], 1)}, point_id) AS n FROM field WHERE timestep % 2 = 0) WHERE n <= 60)""",
    )
    + "SELECT f.timestep, window_id, point_id, u FROM field f JOIN picked USING (point_id) WHERE f.timestep // 2 = window_id",
)
def selection_per_window(spark, sf):
    stepped = windows.with_windows(views.field(spark, sf), 2)
    chosen = draw(windows.first_steps(stepped, 2), 60, ["point_id"], TS, seed=1).select("window_id", "point_id")
    return windows.apply_selection(stepped, chosen).select("timestep", "window_id", "point_id", "u")


@query(
    "c04_label_strengths",
    with_(FIELD, CENTRES, LABELS, cluster_hist("labelled", ["u"], 4, 10), probabilities(), kl(), "st AS (SELECT timestep, j AS label, sum(kl) AS strength FROM kl GROUP BY ALL)")
    + "SELECT timestep, point_id, label, round(strength, 6) AS strength FROM labelled JOIN st USING (timestep, label)",
)
def label_strengths(spark, sf):
    rows = _labelled_field(spark, sf)
    hist = cluster_histogram(rows, ["u"], 4, 10, TS)
    strengths = small_side(in_strengths(distributions(hist, TS, normalised=True), TS))
    return rows.join(strengths, ["timestep", "label"]).select("timestep", "point_id", "label", rounded("strength"))


@query(
    "c05_nearest_centre",
    with_(VECTORS, midpoints("vectors", views.COMPONENTS, 5), labelled("vectors", views.COMPONENTS, 5))
    + "SELECT point_id, label FROM labelled",
)
def nearest_centre(spark, sf):
    cols = views.COMPONENTS
    v = views.vectors(spark, sf)
    return assign(v, cols, midpoint_centres(v, cols, 5, TS), 5, TS).select("point_id", "label")


@query(
    "c06_cluster_bin_join",
    with_(FIELD, CENTRES, LABELS, cluster_hist("labelled", ["u"], 4, 10), probabilities())
    + """SELECT a.timestep, a.bin, a.label AS i, b.label AS j, round(a.p * ln(a.p / b.p), 8) AS term
FROM dist a JOIN dist b ON a.timestep = b.timestep AND a.bin = b.bin""",
)
def cluster_bin_join(spark, sf):
    d = distributions(cluster_histogram(_labelled_field(spark, sf), ["u"], 4, 10, TS), TS, normalised=True)
    a = d.select("timestep", "bin", F.col("label").alias("i"), F.col("p").alias("p"))
    b = d.select("timestep", "bin", F.col("label").alias("j"), F.col("p").alias("q"))
    term = kl_term(F.col("p"), F.col("q"))
    return a.join(b, ["timestep", "bin"]).select("timestep", "bin", "i", "j", rounded(term, 8, "term"))


def design_sql(view: str, cols: list[str], n: int, seed: int = 0, unit: bool = False) -> str:
    """CTE of the Latin hypercube design per timestep."""
    parts = ["timestep", "design_id"]
    axes = ", ".join(
        f"(row_number() OVER (PARTITION BY timestep ORDER BY {key(parts, f'perm{a}-{seed}')}, design_id) - 1 + {key(parts, f'place{a}-{seed}')})"
        f" / CAST({n} AS DOUBLE) AS d{a}"
        for a in range(len(cols))
    )
    base = f"""unit AS (SELECT timestep, design_id, {axes} FROM (SELECT DISTINCT timestep FROM {view})
CROSS JOIN (SELECT CAST(range AS BIGINT) AS design_id FROM range({n})))"""
    if unit:
        return base
    scaled = ", ".join(f"lo{a} + d{a} * (hi{a} - lo{a}) AS t{a}" for a in range(len(cols)))
    lim = ", ".join(f"min({c}) AS lo{a}, max({c}) AS hi{a}" for a, c in enumerate(cols))
    return f"""{base},
design AS (SELECT timestep, design_id, {scaled} FROM unit JOIN (SELECT timestep, {lim} FROM {view} GROUP BY timestep) USING (timestep))"""


def greedy_sql(view: str, cols: list[str], n: int) -> str:
    """CTEs: in design order, the nearest row not taken before."""
    gap = " + ".join(f"({c} - t{a}) * ({c} - t{a})" for a, c in enumerate(cols))
    out = []
    for i in range(n):
        free = "".join(f" AND point_id NOT IN (SELECT point_id FROM pick{j} x WHERE x.timestep = v.timestep)" for j in range(i))
        out.append(
            f"pick{i} AS MATERIALIZED (SELECT timestep, design_id, point_id FROM (SELECT v.timestep, design_id, point_id, row_number() OVER "
            f"(PARTITION BY v.timestep ORDER BY sqrt({gap}), point_id) AS n FROM {view} v JOIN design d ON d.timestep = v.timestep "
            f"AND design_id = {i} WHERE true{free}) WHERE n = 1)"
        )
    return ", ".join(out)


def _all_picks(n: int) -> str:
    return " UNION ALL ".join(f"SELECT timestep, design_id, point_id FROM pick{i}" for i in range(n))


@query(
    "c07_nearest_free_sample",
    with_(CLOUD, design_sql("cloud", ["x0", "x1"], 5, 11), greedy_sql("cloud", ["x0", "x1"], 5)) + _all_picks(5),
)
def nearest_free_sample(spark, sf):
    picked = latin_hypercube(views.cloud(spark, sf), 5, feature_cols=["x0", "x1"], seed=11, keep=2)
    return picked.select("timestep", "design_id", "point_id")


@query(
    "c08_selected_points_gathered",
    with_(
        FIELD,
        f"""picked AS (SELECT timestep, point_id FROM (SELECT *, row_number() OVER (PARTITION BY timestep
ORDER BY {race(['timestep', 'point_id'], 2)}, point_id) AS n FROM field) WHERE n <= 50)""",
    )
    + """SELECT timestep, point_id, round(gx * (1.0::DOUBLE / 10 * 5) / 4, 9) AS x, u, v, w FROM field JOIN picked USING (timestep, point_id)""",
)
def selected_points_gathered(spark, sf):
    f = views.field(spark, sf)
    chosen = draw(f, 50, ["point_id"], TS, seed=2).select("timestep", "point_id")
    rows = gather_points(chosen, f, ["timestep", "point_id"])
    return rows.select("timestep", "point_id", rounded(grid.axis_coordinate(F.col("gx"), 1.0, 10, 5), 9, "x"), "u", "v", "w")


FORCES = """forces AS (SELECT CAST(o_orderkey AS DOUBLE) * 0.5 AS "time", o_totalprice AS drag FROM orders)"""


def _forces(spark, sf):
    return views.table(spark, sf, "orders").select((F.col("o_orderkey") * F.lit(0.5)).alias("time"), F.col("o_totalprice").alias("drag"))


@query(
    "c09_force_at_snapshot",
    with_(FORCES) + """SELECT event_id AS snapshot, "time", drag, value FROM events JOIN forces ON CAST("time" * 2 AS BIGINT) = event_id""",
)
def force_at_snapshot(spark, sf):
    snaps = views.table(spark, sf, "events").select(F.col("event_id").alias("snapshot"), "value")
    return forces_at_snapshots(snaps, _forces(spark, sf), 0.5)


@query(
    "c09_force_as_of",
    """WITH times AS (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS timestep FROM events),
f AS (SELECT timestep + 0.25::DOUBLE AS t, round(avg(value), 6) AS drag FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS timestep, value FROM events)
GROUP BY timestep HAVING timestep % 3 = 0)
SELECT CAST(s.timestep AS DOUBLE) AS snapshot, (SELECT arg_max(drag, t) FROM f WHERE t <= s.timestep) AS drag FROM times s""",
)
def force_as_of(spark, sf):
    c = views.cloud(spark, sf)
    daily = c.groupBy("timestep").agg(F.round(F.avg("x0"), 6).alias("drag")).where(F.pmod("timestep", F.lit(3)) == 0)
    forces = daily.select((F.col("timestep") + F.lit(0.25)).alias("time"), "drag")
    return latest_force(c.select(F.col("timestep").alias("snapshot")).distinct(), forces)


@query(
    "c10_times_within_tolerance",
    with_(FRAMES)
    + """, have AS (SELECT DISTINCT frame + 0.5::DOUBLE AS ts FROM frames),
want AS (SELECT DISTINCT frame + 0.5::DOUBLE + CASE WHEN frame % 3 = 0 THEN 5e-7::DOUBLE WHEN frame % 3 = 1 THEN 2e-6::DOUBLE ELSE 0 END AS requested FROM frames)
SELECT requested, min(ts) AS timestep FROM want LEFT JOIN have ON abs(ts - requested) < 1e-6 GROUP BY requested""",
)
def times_within_tolerance(spark, sf):
    times = views.frames(spark, sf).select("frame").distinct()
    slip = F.when(F.col("frame") % 3 == 0, F.lit(5e-7)).when(F.col("frame") % 3 == 1, F.lit(2e-6)).otherwise(F.lit(0.0))
    at = F.col("frame") + F.lit(0.5)
    return match_times(times.select((at + slip).alias("requested")), times.select(at.alias("timestep")))


# --- windows ------------------------------------------------------------------


@query(
    "e01_sliding_sequences",
    with_(FIELD)
    + """SELECT gx // 5 + 2 * (gy // 5 + gz // 5) AS cube_id, s.start, timestep - s.start * 2 AS step, point_id, u
FROM field JOIN (SELECT CAST(range AS BIGINT) AS start FROM range(2)) s ON timestep >= s.start * 2 AND timestep < s.start * 2 + 3""",
)
def sliding_sequences(spark, sf):
    f = grid.with_box(views.field(spark, sf), BOX).withColumn("cube_id", grid.box_number((2, 1, 0)))
    return windows.sequences(f, 3, 1).select("cube_id", "start", "step", "point_id", "u")


@query(
    "e02_tumbling_windows",
    with_(FIELD) + "SELECT timestep, timestep // 4 AS window_id, point_id FROM field WHERE timestep // 4 < 6 // 4",
)
def tumbling_windows(spark, sf):
    return windows.with_windows(views.field(spark, sf), 4).select("timestep", "window_id", "point_id")


@query(
    "e03_strata",
    with_(CLOUD) + "SELECT timestep, point_id, CAST(ntile(7) OVER (PARTITION BY timestep ORDER BY x0, point_id) - 1 AS BIGINT) AS stratum FROM cloud",
)
def strata(spark, sf):
    ranked = global_rank(views.cloud(spark, sf), ["x0", "point_id"], TS, "rank", size="size")
    return ranked.select("timestep", "point_id", stratum(F.col("rank"), F.col("size"), 7).alias("stratum"))


@query(
    "e04_position_in_bin",
    with_(
        CLOUD,
        "lim AS (SELECT timestep, min(x0) AS a, max(x0) AS b, min(x1) AS c, max(x1) AS d FROM cloud GROUP BY timestep)",
        f"binned AS (SELECT timestep, point_id, {bin_of('x0', 'a', 'b', 5)} * 5 + {bin_of('x1', 'c', 'd', 5)} AS bin_id FROM cloud JOIN lim USING (timestep))",
    )
    + "SELECT timestep, bin_id, point_id, row_number() OVER (PARTITION BY timestep, bin_id ORDER BY point_id) - 1 AS position FROM binned",
)
def position_in_bin(spark, sf):
    from cellsift.operators.histogram import phase_bins

    binned = phase_bins(views.cloud(spark, sf), ["x0", "x1"], 5, TS)
    return global_rank(binned, ["point_id"], ["timestep", "bin_id"], "position").select("timestep", "bin_id", "point_id", "position")


@query(
    "e05_energy_intervals",
    with_(SNAPSHOTS)
    + """, d AS (SELECT node_id, phase AS to_phase, lag(phase) OVER w AS from_phase, "timestamp" - lag("timestamp") OVER w AS elapsed,
CPU - lag(CPU) OVER w AS cpu, Mem - lag(Mem) OVER w AS mem, Accel0 - lag(Accel0) OVER w AS a0, Accel1 - lag(Accel1) OVER w AS a1,
Accel2 - lag(Accel2) OVER w AS a2, Accel3 - lag(Accel3) OVER w AS a3 FROM snapshots WINDOW w AS (PARTITION BY node_id ORDER BY "timestamp", phase)),
t AS (SELECT *, coalesce(cpu, 0) + coalesce(mem, 0) + coalesce(a0, 0) + coalesce(a1, 0) + coalesce(a2, 0) + coalesce(a3, 0) AS joules FROM d WHERE elapsed IS NOT NULL)
SELECT node_id, from_phase, to_phase, elapsed, round(cpu, 3) AS d_cpu, round(a3, 3) AS d_accel3, round(joules, 3) AS joules,
round(CASE WHEN elapsed > 0 THEN joules / elapsed END, 3) AS watts FROM t""",
)
def energy_intervals(spark, sf):
    steps = intervals(views.snapshots(spark, sf))
    return steps.select(
        "node_id", "from_phase", "to_phase", "elapsed", rounded("d_CPU", 3, "d_cpu"), rounded("d_Accel3", 3, "d_accel3"),
        rounded("joules", 3), rounded("watts", 3),
    )


@query(
    "e06_dense_time_index",
    with_(CLOUD) + "SELECT timestep, dense_rank() OVER (ORDER BY timestep) - 1 AS t_idx, count(*) OVER () AS n_t FROM (SELECT DISTINCT timestep FROM cloud)",
)
def dense_time_index(spark, sf):
    return windows.time_index(views.cloud(spark, sf))


@query(
    "e07_ordered_split",
    with_(FIELD)
    + """, s AS (SELECT cube, start, row_number() OVER (ORDER BY cube, start) - 1 AS r, count(*) OVER () AS n FROM
(SELECT DISTINCT gx // 5 + 2 * (gz // 5) AS cube FROM field) CROSS JOIN (SELECT CAST(range AS BIGINT) AS start FROM range(5)))
SELECT cube AS cube_id, start, CASE WHEN r >= n - ceil(n * CAST(0.15 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM s""",
)
def ordered_split(spark, sf):
    f = views.field(spark, sf).withColumn("cube_id", int_div("gx", 5) + 2 * int_div("gz", 5))
    rows = windows.sequences(f.select("timestep", "cube_id").distinct(), 2, 1)
    return windows.ordered_split(rows.select("cube_id", "start").distinct(), ["cube_id", "start"], 0.15)


@query(
    "e07_shuffled_split",
    f"""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY {key(['doc_id'], 'split-4')}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r >= n - ceil(n * CAST(0.1 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM s""",
)
def shuffled_split(spark, sf):
    return windows.ordered_split(views.table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.1, shuffle=True, seed=4)


# --- sorts, limits, top-k -----------------------------------------------------


@query(
    "f01_numeric_name_order",
    with_(FRAMES) + "SELECT name, row_number() OVER (ORDER BY frame) - 1 AS position FROM (SELECT DISTINCT frame, 'cube_enst.' || frame AS name FROM frames)",
)
def numeric_name_order(spark, sf):
    names = views.frames(spark, sf).select(F.concat(F.lit("cube_enst."), F.col("frame").cast("string")).alias("name")).distinct()
    number = scalars.time_from_name(F.col("name"), scalars.TIME_IN_CUBE_NAME)
    return global_rank(names.withColumn("number", number), ["number"], (), "position").select("name", "position")


@query(
    "f02_all_boxes_when_short",
    with_(FIELD) + "SELECT DISTINCT timestep, gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz FROM field",
)
def all_boxes_when_short(spark, sf):
    f = views.field(spark, sf)
    every = boxes.all_boxes(f, (2, 1, views.depth(f) // 5), TS)
    return boxes.random_boxes(every, 1_000_000_000, TS).select("timestep", "ix", "iy", "iz")


@query(
    "f03_centres_sorted",
    with_(VECTORS, midpoints("vectors", views.COMPONENTS, 4), labelled("vectors", views.COMPONENTS, 4))
    + f"""SELECT row_number() OVER (ORDER BY {", ".join(views.COMPONENTS)}) - 1 AS label, {", ".join(f"round({c}, 6) AS {c}" for c in views.COMPONENTS)} FROM
(SELECT {", ".join(f"avg({c}) AS {c}" for c in views.COMPONENTS)} FROM labelled GROUP BY label)""",
)
def centres_sorted(spark, sf):
    v = views.vectors(spark, sf)
    cols = views.COMPONENTS
    rows = assign(v, cols, midpoint_centres(v, cols, 4, TS), 4, TS)
    means = rows.groupBy("timestep", "label").agg(F.array(*[F.avg(c) for c in cols]).alias("m"))
    packed = means.groupBy("timestep").agg(F.collect_list("m").alias("centres"))
    one = sort_centres(packed).select(F.posexplode("centres").alias("label", "c"))
    return one.select(F.col("label").cast("long"), *[F.round(F.col("c")[i], 6).alias(c) for i, c in enumerate(cols)])


@query(
    "f04_smallest_value",
    with_(CLOUD) + "SELECT timestep, arg_min(point_id, (x0, point_id)) AS point_id, min(x0) AS x0 FROM cloud GROUP BY timestep",
)
def smallest_value(spark, sf):
    c = views.cloud(spark, sf)
    return c.groupBy("timestep").agg(F.min_by("point_id", F.struct("x0", "point_id")).alias("point_id"), F.min("x0").alias("x0"))


@query(
    "f05_weighted_top_k",
    with_(DOCS) + f"SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {race(['lang', 'doc_id'], 6, 'n_chars')}, doc_id) AS n FROM docs WHERE n_chars > 0) WHERE n <= 10",
)
def weighted_top_k(spark, sf):
    picked = draw(views.docs(spark, sf), 10, ["doc_id"], ["lang"], weight="n_chars", seed=6, short="all")
    return picked.select("lang", "doc_id")


# --- set operations -----------------------------------------------------------


@query(
    "g01_concatenated",
    with_(FIELD) + "SELECT timestep, point_id, u AS value FROM field UNION ALL SELECT timestep, point_id, v FROM field",
)
def concatenated(spark, sf):
    f = views.field(spark, sf)
    one = lambda c: f.select("timestep", "point_id", F.col(c).alias("value"))
    return one("u").unionByName(one("v"))


@query(
    "g02_rows_not_chosen",
    with_(CLOUD)
    + f"""SELECT timestep, point_id FROM (SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], 8)}, point_id) AS n FROM cloud) WHERE n > 20""",
)
def rows_not_chosen(spark, sf):
    c = views.cloud(spark, sf)
    chosen = draw(c, 20, ["point_id"], TS, seed=8, short="all")
    return not_yet_chosen(c, chosen, ["timestep", "point_id"]).select("timestep", "point_id")


@query(
    "g03_partial_totals_merged",
    with_(FIELD) + "SELECT gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz, round(sum(u), 2) AS total FROM field GROUP BY ALL",
)
def partial_totals_merged(spark, sf):
    f = grid.with_box(views.field(spark, sf), BOX)
    part = f.groupBy("timestep", "ix", "iy", "iz").agg(F.sum("u").alias("part"))
    return part.groupBy("ix", "iy", "iz").agg(F.round(F.sum("part"), 2).alias("total"))


@query(
    "g04_available_and_requested",
    with_(CLOUD) + "SELECT DISTINCT timestep FROM cloud INTERSECT SELECT DISTINCT (o_orderkey % 50) * 2 AS timestep FROM orders",
)
def available_and_requested(spark, sf):
    have = views.cloud(spark, sf).select("timestep")
    want = views.table(spark, sf, "orders").select((F.pmod("o_orderkey", F.lit(50)) * 2).alias("timestep"))
    # Intersect joins before it drops repeats: without the distinct ones, all rows of a timestep meet in one task.
    return have.distinct().intersect(want.distinct())


# --- scalar functions ---------------------------------------------------------


@query("h01_cell_to_box", with_(FIELD) + "SELECT timestep, point_id, gx // 3 AS ix, gy // 2 AS iy, gz // 4 AS iz FROM field")
def cell_to_box(spark, sf):
    return grid.with_box(views.field(spark, sf), (3, 2, 4)).select("timestep", "point_id", "ix", "iy", "iz")


@query(
    "h02_flat_numbers",
    with_(FIELD)
    + """SELECT timestep, point_id, gx // 5 + 2 * (gy // 5 + gz // 5) AS box_no, ((gx % 5) * 5 + gy % 5) * 5 + gz % 5 AS local_id, gx // 5 AS ix, gz // 5 AS iz FROM field""",
)
def flat_numbers(spark, sf):
    counts = (2, 1, 1)
    f = grid.with_box(views.field(spark, sf), BOX).withColumns({"box_no": grid.box_number(counts), "local_id": grid.local_number(BOX)})
    back = grid.box_from_number("box_no", counts)
    return f.select("timestep", "point_id", "box_no", "local_id", back["ix"].alias("ix"), back["iz"].alias("iz"))


@query("h03_sample_to_cell", with_(FIELD) + "SELECT timestep, point_id, gx, gy, gz FROM field")
def sample_to_cell(spark, sf):
    f = grid.with_box(views.field(spark, sf), BOX).withColumn("local_id", grid.local_number(BOX))
    cell = grid.cell_from_local("local_id", BOX)
    return f.select("timestep", "point_id", *[c.alias(n) for n, c in cell.items()])


@query(
    "h04_cell_coordinates",
    with_(FIELD)
    + """SELECT timestep, point_id, round(2.0::DOUBLE / 8 * 1 + (gx - 1) / 2.0::DOUBLE * (2.0::DOUBLE / 8 * 4 * 2) / 3, 9) AS x,
round(gy * (2.0::DOUBLE / 5 * 5) / 4, 9) AS y, round(gz * (0.5::DOUBLE / 5 * 5) / 4, 9) AS z, round((gx % 5) / 4.0::DOUBLE, 9) AS unit_x FROM field""",
)
def cell_coordinates(spark, sf):
    p = CurationParams(nx=10, ny=5, nz=5, nxsl=4, nysl=5, nzsl=5, nxskip=2, nxoffset=1, pad=2, Lh=2.0, Lv=0.5, gravity="z")
    f = grid.with_coordinates(views.field(spark, sf), p)
    unit = grid.unit_coordinate(F.pmod("gx", F.lit(5)), 5)
    return f.select("timestep", "point_id", *[rounded(c, 9) for c in ("x", "y", "z")], rounded(unit, 9, "unit_x"))


@query(
    "h05_log_energy",
    with_(CLOUD) + "SELECT point_id, round(ln(CASE WHEN abs(x0 - 30) <= 1e-9 THEN 1e-8 ELSE abs(x0 - 30) END), 8) AS log_tke FROM cloud",
)
def log_energy(spark, sf):
    return views.cloud(spark, sf).select("point_id", rounded(scalars.log_energy(F.col("x0") - 30), 8, "log_tke"))


@query(
    "h06_euclidean",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
m AS (SELECT vec_id, a, list_reverse(a) AS b FROM e)
SELECT vec_id, round(sqrt(a[1] * a[1] + a[2] * a[2]), 9) AS norm2, round(list_distance(a, b), 9) AS distance FROM m""",
)
def euclidean(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    norm2 = scalars.norm([F.col("a")[0], F.col("a")[1]])
    return e.select("vec_id", rounded(norm2, 9, "norm2"), rounded(scalars.array_distance(F.col("a"), F.reverse("a")), 9, "distance"))


@query(
    "h07_weights_rescaled",
    with_(DOCS) + """SELECT doc_id, round((n_chars - min(n_chars) OVER w) * (CAST(0.99 AS DOUBLE) - 0.01) / (max(n_chars) OVER w - min(n_chars) OVER w) + 0.01, 9) AS weight
FROM docs WINDOW w AS (PARTITION BY lang)""",
)
def weights_rescaled(spark, sf):
    return scalars.rescale(views.docs(spark, sf), "n_chars", "weight", ["lang"]).select("doc_id", rounded("weight", 9))


@query(
    "h08_names_and_times",
    with_(FRAMES) + "SELECT DISTINCT printf('u_%.6f', frame * CAST(0.25 AS DOUBLE)) AS name, frame * CAST(0.25 AS DOUBLE) AS timestep FROM frames",
)
def names_and_times(spark, sf):
    times = views.frames(spark, sf).select((F.col("frame") * F.lit(0.25)).alias("t")).distinct()
    named = times.select(scalars.name_from_time(F.lit("u"), F.col("t")).alias("name"))
    return named.withColumn("timestep", scalars.time_from_name(F.col("name")))


@query(
    "h09_block_origin",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0 ELSE (p_partkey % 8) * 256 END AS x0, (p_partkey // 8) % 8 * 256 AS y0, p_partkey % 8 * 256 AS z0 FROM part""",
)
def block_origin(spark, sf):
    part = views.table(spark, sf, "part")
    # Even sizes stand for files that lie in their block's folder.
    path = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("/d/3/")).otherwise(F.lit("/d/all/")), F.lit("cube_enst."), F.col("p_partkey").cast("string"))
    rows = part.select("p_partkey", path.alias("path"), F.pmod("p_partkey", F.lit(8)).alias("block"))
    number = F.regexp_extract("path", r"\.(\d+)$", 1).cast("long")
    in_dir = F.regexp_extract("path", r"/(\d+)/[^/]+$", 1) != ""
    origin = grid.block_origin(number, F.col("block"), in_dir, 8, 256)
    return rows.select("p_partkey", *[c.alias(n) for n, c in origin.items()])


@query(
    "h10_float32_values",
    with_(FRAMES) + "SELECT frame + 0.5::DOUBLE AS timestep, round(sum(CAST(CAST(u AS FLOAT) AS DOUBLE)), 3) AS total, min(CAST(CAST(u AS FLOAT) AS DOUBLE)) AS lo FROM frames GROUP BY ALL",
)
def float32_values(spark, sf):
    from cellsift.plans.queries_sources import raw_grid_scan

    cells = raw_grid_scan(spark, sf)
    return cells.groupBy("timestep").agg(F.round(F.sum("u"), 3).alias("total"), F.min("u").alias("lo"))


@query(
    "h11_bin_index",
    with_(LINE_ITEMS)
    + f"""SELECT timestep, bin, count(*) AS cnt FROM (SELECT timestep, {bin_of('price', 'lo', 'hi', 20)} AS bin FROM li
JOIN (SELECT timestep, min(price) AS lo, max(price) AS hi FROM li GROUP BY timestep) USING (timestep)) GROUP BY ALL""",
)
def bin_indexes(spark, sf):
    li = views.line_items(spark, sf)
    rows = li.join(small_side(pooled_limits(li, ["price"], TS)), TS)
    binned = rows.select("timestep", bin_index(F.col("price"), F.col("lo"), F.col("hi"), 20).alias("bin"))
    return binned.groupBy("timestep", "bin").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "h12_kl_term",
    with_(CLOUD) + "SELECT point_id, round((x0 + 1) * ln((x0 + 1) / (x1 + 1)), 6) AS term FROM cloud",
)
def kl_terms(spark, sf):
    return views.cloud(spark, sf).select("point_id", rounded(kl_term(F.col("x0") + 1, F.col("x1") + 1), 6, "term"))


@query(
    "h13_flat_phase_bin",
    with_(CLOUD, "lim AS (SELECT timestep, min(x0) AS a, max(x0) AS b, min(x1) AS c, max(x1) AS d FROM cloud GROUP BY timestep)")
    + f"SELECT point_id, {bin_of('x0', 'a', 'b', 10)} * 10 + {bin_of('x1', 'c', 'd', 10)} AS bin_id FROM cloud JOIN lim USING (timestep)",
)
def flat_phase_bin(spark, sf):
    c = views.cloud(spark, sf)
    rows = c.join(small_side(axis_limits(c, ["x0", "x1"], TS)), TS)
    axis = [bin_index(F.col(x), F.col(f"lo_{x}"), F.col(f"hi_{x}"), 10) for x in ("x0", "x1")]
    return rows.select("point_id", flat_bin(axis, 10).alias("bin_id"))


@query(
    "h14_latin_design",
    with_(CLOUD, design_sql("cloud", ["x0", "x1"], 12, 2, unit=True)) + "SELECT timestep, design_id, round(d0, 9) AS d0, round(d1, 9) AS d1 FROM unit",
)
def latin_design(spark, sf):
    unit = scalars.latin_design(spark, views.cloud(spark, sf), 12, 2, TS, 2)
    return unit.select("timestep", "design_id", rounded("d0", 9), rounded("d1", 9))


@query(
    "h15_channels_first",
    with_(FIELD)
    + """SELECT gz AS plane, list(u ORDER BY timestep, point_id) AS u, list(v ORDER BY timestep, point_id) AS v FROM field GROUP BY gz""",
)
def channels_first(spark, sf):
    f = views.field(spark, sf).withColumn("plane", F.col("gz"))
    packed = windows.pack(f, ["plane"], ["timestep", "point_id"], ["u", "v"])
    return windows.channels_first(packed, ["u", "v"])

