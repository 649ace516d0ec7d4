"""Selection of boxes and points."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cellsift.functions.grid import AXES
from cellsift.operators import boxes, samplers
from cellsift.operators.histogram import phase_histogram
from cellsift.params import CurationParams
from cellsift.plans import views
from cellsift.plans.catalog import query
from cellsift.plans.curate import curate, curate_archive, write
from cellsift.plans.queries_aggregates import BOX_TOTALS, K, maxent_ctes, picks, uips_ctes
from cellsift.plans.queries_learning import lloyd_ctes
from cellsift.plans.queries_relational import _all_picks, design_sql, greedy_sql
from cellsift.plans.queries_sources import raw_frames
from cellsift.plans.sqltext import cluster_hist, key, labelled, probabilities, race, with_
from cellsift.plans.views import CLOUD, DOCS, FIELD, FRAMES, VECTORS
from cellsift.session import scratch_path

TS = ["timestep"]
BOX = views.BOX

EVERY_BOX = "every_box AS (SELECT DISTINCT timestep, gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz, gx // 5 + 2 * (gy // 5 + gz // 5) AS box_no FROM field)"


def box_draw(rows: str, n: int, weight: str | None = None, keys: str = "ix, iy, iz", seed: int = 0) -> str:
    parts = ["timestep", *[k.strip() for k in keys.split(",")]]
    return f"""SELECT timestep, ix, iy, iz FROM (SELECT *, row_number() OVER (PARTITION BY timestep
ORDER BY {race(parts, f'box-{seed}', weight)}, {keys}) AS pick FROM {rows}) WHERE pick <= {n}"""


def _params(spark, sf, **changes) -> CurationParams:
    shape = dict(nx=views.NX, ny=views.NY, nz=views.depth(views.field(spark, sf)), pad=0)
    size = dict(nxsl=5, nysl=5, nzsl=5)
    base = dict(cluster_var=("u",), input_vars=("u", "v"), output_vars=("w",), num_clusters=K, kmeans_rounds=0, starts="fixed")
    return CurationParams(**{**shape, **size, **base, **changes})


@query("j01_random_boxes", with_(FIELD, EVERY_BOX) + box_draw("every_box", 2, keys="box_no"))
def random_boxes(spark, sf):
    chosen = boxes.select_boxes(views.field(spark, sf), _params(spark, sf, hypercubes="random", num_hypercubes=2))
    return chosen.select("timestep", "ix", "iy", "iz")


@query("j02_uniform_boxes", with_(FIELD, EVERY_BOX) + "SELECT timestep, ix, iy, iz FROM every_box WHERE box_no < 4")
def uniform_boxes(spark, sf):
    chosen = boxes.select_boxes(views.field(spark, sf), _params(spark, sf, hypercubes="uniform", num_hypercubes=4))
    return chosen.select("timestep", "ix", "iy", "iz")


@query("j03_maxent_boxes", with_(*BOX_TOTALS) + box_draw("totals", 2, "total"))
def maxent_boxes(spark, sf):
    f = views.field(spark, sf)
    p = _params(spark, sf, hypercubes="maxent", num_hypercubes=2)
    chosen = boxes.select_boxes(f, p)
    return chosen.select("timestep", "ix", "iy", "iz")


@query(
    "j03_top_boxes",
    with_(*BOX_TOTALS) + "SELECT timestep, ix, iy, iz, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY total DESC, ix, iy, iz) AS n FROM totals) WHERE n <= 2",
)
def top_boxes(spark, sf):
    f = views.field(spark, sf)
    totals = boxes.score_boxes(f, ["u"], K, BOX, TS, 10, 0)
    return boxes.top_boxes(totals, 2, TS).select("timestep", "ix", "iy", "iz", F.col("rank").cast("long"))


@query("j04_random_points", with_(CLOUD, picks("p", "cloud", 15, 7)) + "SELECT timestep, point_id, x0, x1 FROM p")
def random_points(spark, sf):
    return samplers.random(views.cloud(spark, sf), 15, seed=7)


@query(
    "j04_random_documents",
    with_(DOCS)
    + f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {race(['lang', 'doc_id'], 1)}, doc_id) AS n FROM docs) WHERE n <= 10",
)
def random_documents(spark, sf):
    return samplers.random(views.docs(spark, sf), 10, id_col="doc_id", group_cols=["lang"], seed=1).select("doc_id", "lang")


@query("j05_maxent_points", with_(FIELD, *maxent_ctes("field", "u", 100, 5, 50, 2)) + "SELECT timestep, point_id, label FROM maxent_picks")
def maxent_points(spark, sf):
    f = views.field(spark, sf)
    picked = samplers.maxent(f, 100, cluster_cols=["u"], k=5, rounds=0, seed=2)
    return picked.select("timestep", "point_id", "label")


@query("j06_phase_space_points", with_(CLOUD, *uips_ctes("cloud", ["x0", "x1"], 50, 10, 3)) + "SELECT timestep, draw_id, bin_id, point_id FROM uips_picks")
def phase_space_points(spark, sf):
    picked = samplers.phase_space(views.cloud(spark, sf), 50, feature_cols=["x0", "x1"], seed=3)
    return picked.select("timestep", "draw_id", "bin_id", "point_id")


@query(
    "j06_phase_space_vectors",
    with_(VECTORS, *uips_ctes("vectors", views.COMPONENTS, 200, 10, 0, wide=True)) + "SELECT draw_id, array_to_string(bin_id, ',') AS bin_id, point_id FROM uips_picks",
)
def phase_space_vectors(spark, sf):
    picked = samplers.phase_space(views.vectors(spark, sf), 200, feature_cols=views.COMPONENTS, chunk_rows=50)
    return picked.select("draw_id", F.array_join(F.col("bin_id").cast("array<string>"), ",").alias("bin_id"), "point_id")


@query(
    "j07_latin_hypercube_points",
    with_(VECTORS, design_sql("vectors", views.COMPONENTS, 8, 5), greedy_sql("vectors", views.COMPONENTS, 8)) + _all_picks(8),
)
def latin_hypercube_points(spark, sf):
    picked = samplers.latin_hypercube(views.vectors(spark, sf), 8, feature_cols=views.COMPONENTS, seed=5, chunk_rows=100, keep=2)
    return picked.select("timestep", "design_id", "point_id")


@query(
    "d09_phase_histogram_vectors",
    with_(VECTORS, *uips_ctes("vectors", views.COMPONENTS, 1, 3, 0, wide=True)[:2]) + "SELECT array_to_string(bin_id, ',') AS bin_id, count(*) AS cnt FROM ubin GROUP BY bin_id",
)
def phase_histogram_vectors(spark, sf):
    """Sparse counts of bins in 64 dimensions, three bins along each."""
    counts = phase_histogram(views.vectors(spark, sf), views.COMPONENTS, 3, TS)
    return counts.select(F.array_join(F.col("bin_id").cast("array<string>"), ",").alias("bin_id"), "cnt")


@query(
    "j08_stratified_points",
    with_(
        CLOUD,
        "strata AS (SELECT timestep, point_id, CAST(ntile(9) OVER (PARTITION BY timestep ORDER BY x0, point_id) - 1 AS BIGINT) AS stratum FROM cloud)",
    )
    + f"SELECT timestep, stratum, arg_min(point_id, ({key(['timestep', 'point_id'], 'stratum-4')}, point_id)) AS point_id FROM strata GROUP BY ALL",
)
def stratified_points(spark, sf):
    picked = samplers.stratified(views.cloud(spark, sf), 9, feature_cols=["x0"], seed=4)
    return picked.select("timestep", "stratum", "point_id")


@query("j09_full", with_(CLOUD) + "SELECT timestep, point_id, x0, x1 FROM cloud")
def full_points(spark, sf):
    return samplers.full(views.cloud(spark, sf))


@query(
    "j10_all_timesteps_at_once",
    with_(FIELD, picks("p", "field", 64, 12)) + "SELECT timestep, count(*) AS n, min(point_id) AS lo, max(point_id) AS hi FROM p GROUP BY timestep",
)
def all_timesteps_at_once(spark, sf):
    picked = views.field(spark, sf).transform(samplers.SAMPLERS["random"], 64, seed=12)
    return picked.groupBy("timestep").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("lo"), F.max("point_id").alias("hi"))


@query(
    "j16_curation_job",
    with_(FIELD, EVERY_BOX)
    + f""", cb AS (SELECT timestep // 2 AS window_id, ix, iy, iz FROM ({box_draw('every_box', 2, keys='box_no')}) WHERE timestep % 2 = 0),
kept AS (SELECT f.*, f.timestep // 2 AS window_id, gx // 5 + 2 * (gy // 5 + gz // 5) AS cube_id FROM field f
  JOIN cb ON cb.window_id = f.timestep // 2 AND ix = gx // 5 AND iy = gy // 5 AND iz = gz // 5),
sel AS (SELECT window_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], 0)}, point_id) AS n
  FROM kept WHERE timestep % 2 = 0) WHERE n <= 20)
SELECT timestep, window_id, cube_id, point_id, u, v, w FROM kept JOIN sel USING (window_id, point_id)""",
)
def curation_job(spark, sf):
    p = _params(spark, sf, hypercubes="random", num_hypercubes=2, method="random", num_samples=10, target="p")
    result = curate(views.field(spark, sf), p)
    keys = ["timestep", "window_id", "cube_id", "point_id"]
    return result.inputs.select(*keys, "u", "v").join(result.targets.select(*keys, "w"), keys)


def staged(ctes, tag: str) -> list[str]:
    """The same CTEs under other names, for a second stage in one statement."""
    names = "lv|rng|cnts|hist|raw_dist|dist|kl|st|labelled|weighted|maxent_picks|totals|cent\\d|lab\\d"
    return [re.sub(rf"\b({names})\b(?! *\()", rf"\1_{tag}", text) for text in ctes]


def _scored(view: str, col: str, rounds: int, bins: int) -> list[str]:
    return [
        *lloyd_ctes(view, [col], K, rounds),
        labelled(view, [col], K, "labelled", f"cent{rounds}"),
        cluster_hist("labelled", [col], K, bins),
        probabilities(),
        "kl AS (SELECT a.timestep, a.label AS i, b.label AS j, sum(a.p * ln(a.p / b.p)) AS divergence FROM dist a JOIN dist b ON a.timestep = b.timestep AND a.bin = b.bin GROUP BY ALL)",
    ]


STAGE_ONE = staged(
    [
        *_scored("field0", "u", 3, 10),
        "st AS (SELECT timestep, i AS label, sum(divergence) AS strength FROM kl WHERE i <> j GROUP BY timestep, i)",
        "totals AS (SELECT timestep, gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz, sum(strength) AS total FROM labelled JOIN st USING (timestep, label) GROUP BY ALL)",
    ],
    "a",
)
STAGE_TWO = staged(
    [
        *_scored("kept0", "u", 3, 50),
        "st AS (SELECT timestep, j AS label, sum(divergence) AS strength FROM kl GROUP BY timestep, j)",
        "weighted AS (SELECT * FROM labelled JOIN st USING (timestep, label))",
        picks("maxent_picks", "weighted", 20, 0, "strength"),
    ],
    "b",
)


@query(
    "j16_maxent_curation_job",
    with_(
        FIELD,
        "field0 AS (SELECT * FROM field WHERE timestep % 2 = 0)",
        *STAGE_ONE,
        f"cb AS (SELECT timestep // 2 AS window_id, ix, iy, iz FROM ({box_draw('totals_a', 2, 'total')}))",
        """kept AS (SELECT f.*, f.timestep // 2 AS window_id, gx // 5 + 2 * (gy // 5 + gz // 5) AS cube_id FROM field f
JOIN cb ON cb.window_id = f.timestep // 2 AND ix = gx // 5 AND iy = gy // 5 AND iz = gz // 5)""",
        "kept0 AS (SELECT * FROM kept WHERE timestep % 2 = 0)",
        *STAGE_TWO,
    )
    + """SELECT k.timestep, k.timestep AS t_idx, k.window_id, k.cube_id, ((k.gx % 5) * 5 + k.gy % 5) * 5 + k.gz % 5 AS local_id, k.point_id, k.gx, k.gy, k.gz,
  round(k.gx / 9.0::DOUBLE, 9) AS x, round(k.gy / 4.0::DOUBLE, 9) AS y, round(0.5::DOUBLE * k.gz / (SELECT max(gz) FROM field), 9) AS z, k.u, k.v
FROM kept k JOIN maxent_picks_b p ON p.window_id = k.window_id AND p.point_id = k.point_id""",
)
def maxent_curation_job(spark, sf):
    """Both stages by maximum entropy, written and read back."""
    p = _params(spark, sf, hypercubes="maxent", num_hypercubes=2, method="maxent", num_samples=10, kmeans_rounds=3, target="p")
    path = scratch_path(spark, "job")
    write(curate(views.field(spark, sf), p), path)
    return spark.read.parquet(f"{path}/inputs").withColumn("timestep", F.col("timestep").cast("long")).withColumns({a: F.round(a, 9) for a in AXES})


@query(
    "j16_archive_job",
    with_(
        FRAMES,
        "every_box AS (SELECT DISTINCT frame + 0.5::DOUBLE AS timestep, gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz, gx // 5 + 2 * (gy // 5 + gz // 5) AS box_no FROM frames)",
        f"cb AS (SELECT CAST(floor(timestep) AS BIGINT) // 2 AS window_id, ix, iy, iz FROM ({box_draw('every_box', 2, keys='box_no')}) WHERE floor(timestep) % 2 = 0)",
        """kept AS (SELECT frame + 0.5::DOUBLE AS timestep, frame // 2 AS window_id, gx + 10 * (gy + 5 * gz) AS point_id, gx // 5 + 2 * (gy // 5 + gz // 5) AS cube_id,
CAST(CAST(u AS FLOAT) AS DOUBLE) AS u, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM frames JOIN cb ON cb.window_id = frame // 2 AND ix = gx // 5 AND iy = gy // 5 AND iz = gz // 5
WHERE frame < (SELECT max(frame) + 1 FROM frames) // 2 * 2)""",
        f"""sel AS (SELECT window_id, point_id FROM (SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], 0)}, point_id) AS n
FROM kept WHERE CAST(floor(timestep) AS BIGINT) % 2 = 0) WHERE n <= 20)""",
    )
    + "SELECT timestep, window_id, cube_id, point_id, u, v FROM kept JOIN sel USING (window_id, point_id)",
)
def archive_job(spark, sf):
    """The job straight from raw grid files; only chosen boxes are read."""
    nx, ny, nz = views.FRAME_GRID
    p = _params(
        spark, sf, nx=nx, ny=ny, nz=nz, hypercubes="random", num_hypercubes=2, method="random", num_samples=10, target="p", output_vars=("v",)
    )
    result = curate_archive(spark, raw_frames(spark, sf), p)
    return result.inputs.select("timestep", "window_id", "cube_id", "point_id", "u", "v")
