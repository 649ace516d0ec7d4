"""Aggregations: histograms, divergences, profiles, errors, energy."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.functions import grid
from cellsift.operators import boxes, evaluate, histogram, profile
from cellsift.operators.cluster import assign, midpoint_centres
from cellsift.operators.divergence import in_strengths, kl_matrix, out_strengths
from cellsift.operators.draw import draw
from cellsift.operators.energy import job_energy, node_energy
from cellsift.operators.samplers import maxent
from cellsift.operators.windows import ordered_split
from cellsift.plans import views
from cellsift.plans.catalog import query, rounded
from cellsift.plans.compare import sample_each
from cellsift.plans.sqltext import bin_of, cluster_hist, key, kl, labelled, midpoints, probabilities, race, with_
from cellsift.plans.views import CLOUD, FIELD, LINE_ITEMS, PREDICTIONS, SNAPSHOTS

TS = ["timestep"]
LI = ["quantity", "price", "discount", "tax"]
K, BINS = 4, 10
FIELD_LABELS = (FIELD, midpoints("field", ["u"], K), labelled("field", ["u"], K))
LI_LABELS = (LINE_ITEMS, midpoints("li", ["quantity", "price"], K), labelled("li", ["quantity", "price"], K))


def labelled_items(spark, sf):
    li = views.line_items(spark, sf)
    cols = ["quantity", "price"]
    return assign(li, cols, midpoint_centres(li, cols, K, TS), K, TS)


def item_distributions(spark, sf):
    hist = histogram.cluster_histogram(labelled_items(spark, sf), ["quantity", "price"], K, BINS, TS)
    return histogram.distributions(hist, TS, normalised=True)


@query(
    "d01_pooled_limits",
    with_(LINE_ITEMS)
    + "SELECT timestep, min(least(quantity, price, discount, tax)) AS lo, max(greatest(quantity, price, discount, tax)) AS hi FROM li GROUP BY timestep",
)
def pooled_limits(spark, sf):
    return histogram.pooled_limits(views.line_items(spark, sf), LI, TS)


@query("d02_cluster_histogram", with_(*LI_LABELS, cluster_hist("labelled", ["quantity", "price"], K, 50)) + "SELECT * FROM hist")
def cluster_histogram(spark, sf):
    """Partial and final counts: the local histograms and their merge."""
    return histogram.cluster_histogram(labelled_items(spark, sf), ["quantity", "price"], K, 50, TS)


@query(
    "d04_distributions",
    with_(*LI_LABELS, cluster_hist("labelled", ["quantity", "price"], K, BINS), probabilities())
    + "SELECT timestep, label, bin, cnt, round(q, 9) AS p FROM dist",
)
def distributions(spark, sf):
    hist = histogram.cluster_histogram(labelled_items(spark, sf), ["quantity", "price"], K, BINS, TS)
    return histogram.distributions(hist, TS).withColumn("p", F.round("p", 9))


KL_ITEMS = (*LI_LABELS, cluster_hist("labelled", ["quantity", "price"], K, BINS), probabilities(), kl())


@query("d05_kl_matrix", with_(*KL_ITEMS) + "SELECT timestep, i, j, round(kl, 6) AS kl FROM kl")
def kl_matrices(spark, sf):
    return kl_matrix(item_distributions(spark, sf), TS).withColumn("kl", F.round("kl", 6) + 0.0)


@query(
    "d06_out_strength",
    with_(*KL_ITEMS) + "SELECT timestep, i AS label, round(sum(kl), 6) AS strength FROM kl WHERE i <> j GROUP BY timestep, i",
)
def out_strength(spark, sf):
    return out_strengths(item_distributions(spark, sf), TS).withColumn("strength", F.round("strength", 6))


@query(
    "d07_in_strength",
    with_(*KL_ITEMS) + "SELECT timestep, j AS label, round(sum(kl), 6) AS strength FROM kl GROUP BY timestep, j",
)
def in_strength(spark, sf):
    return in_strengths(item_distributions(spark, sf), TS).withColumn("strength", F.round("strength", 6))


BOX_TOTALS = (
    *FIELD_LABELS,
    cluster_hist("labelled", ["u"], K, BINS),
    probabilities(),
    kl(),
    "st AS (SELECT timestep, i AS label, sum(kl) AS strength FROM kl WHERE i <> j GROUP BY timestep, i)",
    "totals AS (SELECT timestep, gx // 5 AS ix, gy // 5 AS iy, gz // 5 AS iz, sum(strength) AS total FROM labelled JOIN st USING (timestep, label) GROUP BY ALL)",
)


@query("d08_box_totals", with_(*BOX_TOTALS) + "SELECT timestep, ix, iy, iz, round(total, 4) AS total FROM totals")
def box_totals(spark, sf):
    """The flagship: total out-strength of every box, all timesteps in one job."""
    f = views.field(spark, sf)
    totals = boxes.score_boxes(f, ["u"], K, views.BOX, TS, BINS, rounds=0)
    return totals.withColumn("total", F.round("total", 4))


LIM2 = "lim AS (SELECT timestep, min(x0) AS a, max(x0) AS b, min(x1) AS c, max(x1) AS d FROM cloud GROUP BY timestep)"


@query(
    "d09_phase_histogram",
    with_(CLOUD, LIM2)
    + f"SELECT timestep, {bin_of('x0', 'a', 'b', 10)} * 10 + {bin_of('x1', 'c', 'd', 10)} AS bin_id, count(*) AS cnt FROM cloud JOIN lim USING (timestep) GROUP BY ALL",
)
def phase_histogram(spark, sf):
    return histogram.phase_histogram(views.cloud(spark, sf), ["x0", "x1"], 10, TS)


def density_sql(rows: str, col: str, edges: int, keys: str) -> str:
    bins = edges - 1
    return f"""dl AS (SELECT {keys}, min({col}) AS lo, max({col}) AS hi, count(*) AS n FROM {rows} GROUP BY {keys}),
dc AS (SELECT {keys}, {bin_of(col, 'lo', 'hi', bins)} AS bin, count(*) AS cnt FROM {rows} JOIN dl USING ({keys}) GROUP BY ALL),
density AS (SELECT {keys}, b.bin, coalesce(cnt, 0) AS cnt, coalesce(cnt, 0) / (n * CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END / {bins}) AS density, coalesce(cnt, 0) / n AS area
FROM dl CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range({bins})) b LEFT JOIN dc USING ({keys}, bin))"""


@query(
    "d10_density_histogram",
    with_(LINE_ITEMS, density_sql("li", "price", 21, "timestep"))
    + "SELECT timestep, bin, cnt, round(density, 12) AS density, round(area, 9) AS area FROM density",
)
def density_histogram(spark, sf):
    d = histogram.density_histogram(views.line_items(spark, sf), "price", 21, TS)
    return d.withColumns({"density": F.round("density", 12), "area": F.round("area", 9)})


def kde_sql(rows: str, col: str, points: int, keys: str) -> str:
    return f"""ks AS (SELECT {keys}, count(*) AS n, pow(count(*)::DOUBLE, CAST(-0.2 AS DOUBLE)) * stddev_samp({col}) AS h, min({col}) AS lo,
(max({col}) - min({col})) / {points - 1} AS step FROM {rows} GROUP BY {keys}),
kde AS (SELECT {keys}, g.grid, lo + step * g.grid AS x_at, sum(exp(CAST(-0.5 AS DOUBLE) * pow((lo + step * g.grid - {col}) / h, 2))) / (n * h * sqrt(2 * pi())) AS density
FROM {rows} JOIN ks USING ({keys}) CROSS JOIN (SELECT CAST(range AS BIGINT) AS grid FROM range({points})) g GROUP BY {keys}, g.grid, lo, step, n, h)"""


@query(
    "d11_kernel_density",
    with_(CLOUD, kde_sql("cloud", "x0", 16, "timestep")) + "SELECT timestep, grid, round(x_at, 6) AS x_at, round(density, 9) AS density FROM kde",
)
def kernel_density(spark, sf):
    d = evaluate.density_estimate(views.cloud(spark, sf), "x0", 16, TS)
    return d.withColumns({"x_at": F.round("x_at", 6), "density": F.round("density", 9)})


def picks(name: str, view: str, n: int, seed: int, weight: str | None = None) -> str:
    where = f"WHERE {weight} > 0" if weight else ""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], seed, weight)}, point_id) AS pick
FROM {view} {where}) WHERE pick <= {n})"""


def maxent_ctes(view: str, col: str, n: int, k: int, bins: int, seed: int = 0) -> tuple[str, ...]:
    return (
        midpoints(view, [col], k),
        labelled(view, [col], k),
        cluster_hist("labelled", [col], k, bins),
        probabilities(),
        kl(),
        "st AS (SELECT timestep, j AS label, sum(kl) AS strength FROM kl GROUP BY timestep, j)",
        "weighted AS (SELECT * FROM labelled JOIN st USING (timestep, label))",
        picks("maxent_picks", "weighted", n, seed, "strength"),
    )


def uips_ctes(view: str, cols: list[str], n: int, bins: int, seed: int = 0, wide: bool = False) -> tuple[str, ...]:
    """Draws of bins and of places, with points of a bin in seeded order. ``wide``: bins
    are lists of the bins along each axis."""
    lim = ", ".join(f"min({c}) AS lo{a}, max({c}) AS hi{a}" for a, c in enumerate(cols))
    flat = "CAST(0 AS BIGINT)"
    for a, c in enumerate(cols):
        flat = f"({flat} * {bins} + {bin_of(c, f'lo{a}', f'hi{a}', bins)})"
    if wide:
        flat = f"[{', '.join(bin_of(c, f'lo{a}', f'hi{a}', bins) for a, c in enumerate(cols))}]"
    return (
        f"ulim AS (SELECT timestep, {lim} FROM {view} GROUP BY timestep)",
        f"ubin AS (SELECT v.*, {flat} AS bin_id FROM {view} v JOIN ulim USING (timestep))",
        f"upos AS (SELECT *, row_number() OVER (PARTITION BY timestep, bin_id ORDER BY {key(['timestep', 'point_id'], f'order-{seed}')}, point_id) - 1 AS place FROM ubin)",
        "ucnt AS (SELECT timestep, bin_id, count(*) AS in_bin, row_number() OVER (PARTITION BY timestep ORDER BY bin_id) - 1 AS bin_rank, count(*) OVER (PARTITION BY timestep) AS n_bins FROM ubin GROUP BY timestep, bin_id)",
        f"udraw AS (SELECT t.timestep, d.draw_id, CAST(floor({key(['t.timestep', 'draw_id'], f'bin-{seed}')} * n_bins) AS BIGINT) AS bin_rank, {key(['t.timestep', 'draw_id'], f'place-{seed}')} AS spot "
        f"FROM (SELECT DISTINCT timestep, n_bins FROM ucnt) t CROSS JOIN (SELECT CAST(range AS BIGINT) AS draw_id FROM range({n})) d)",
        "uips_picks AS (SELECT p.*, draw_id FROM udraw u JOIN ucnt c ON c.timestep = u.timestep AND c.bin_rank = u.bin_rank "
        "JOIN upos p ON p.timestep = c.timestep AND p.bin_id = c.bin_id AND p.place = CAST(floor(spot * in_bin) AS BIGINT))",
    )


N_CMP = 20
COMPARE = (
    CLOUD,
    *maxent_ctes("cloud", "x0", N_CMP, K, 50),
    picks("random_picks", "cloud", N_CMP, 0),
    *uips_ctes("cloud", ["x0", "x1"], N_CMP, 10),
    """compared AS (SELECT timestep, 'full' AS method, x0 FROM cloud UNION ALL SELECT timestep, 'random', x0 FROM random_picks
UNION ALL SELECT timestep, 'uips', x0 FROM uips_picks UNION ALL SELECT timestep, 'maxent', x0 FROM maxent_picks)""",
)


@query(
    "d12_methods_compared",
    with_(*COMPARE, density_sql("compared", "x0", 11, "timestep, method"), kde_sql("compared", "x0", 10, "timestep, method"))
    + "SELECT timestep, method, bin, cnt, round(d.density, 9) AS density, round(k.density, 9) AS kde FROM density d JOIN kde k USING (timestep, method) WHERE grid = bin",
)
def methods_compared(spark, sf):
    c = views.cloud(spark, sf)
    samples = sample_each(c, N_CMP, "x0", feature_cols=["x0", "x1"], k=K, rounds=0)
    keys = ["timestep", "method"]
    hist = histogram.density_histogram(samples, "x0", 11, keys)
    kde = evaluate.density_estimate(samples, "x0", 10, keys).select(*keys, F.col("grid").alias("bin"), F.round("density", 9).alias("kde"))
    return hist.join(kde, [*keys, "bin"]).select(*keys, "bin", "cnt", rounded("density", 9), "kde")


@query(
    "d13_shared_bin_probabilities",
    with_(
        *COMPARE,
        "tagged AS (SELECT timestep, 'global' AS source, x0 FROM cloud UNION ALL SELECT timestep, 'random', x0 FROM random_picks UNION ALL SELECT timestep, 'maxent', x0 FROM maxent_picks)",
        "pl AS (SELECT timestep, min(x0) AS lo, max(x0) AS hi FROM cloud GROUP BY timestep)",
        f"pc AS (SELECT timestep, source, {bin_of('x0', 'lo', 'hi', 50)} AS bin, count(*) AS cnt FROM tagged JOIN pl USING (timestep) GROUP BY ALL)",
    )
    + """SELECT timestep, source, b.bin, round(coalesce(cnt, 0) / n, 9) AS p FROM (SELECT timestep, source, count(*) AS n FROM tagged GROUP BY ALL)
CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range(50)) b LEFT JOIN pc USING (timestep, source, bin)""",
)
def shared_bin_probabilities(spark, sf):
    c = views.cloud(spark, sf)
    top = maxent(c, N_CMP, cluster_cols=["x0"], k=K, rounds=0)
    parts = {"global": c, "random": draw(c, N_CMP, ["point_id"], TS, seed=0), "maxent": top}
    both = evaluate.tagged(parts, ["timestep", "x0"], "source")
    p = histogram.shared_bin_probabilities(both, "x0", 50, "source", TS, histogram.pooled_limits(c, ["x0"], TS))
    return p.withColumn("p", F.round("p", 9))


@query("d14_cluster_sizes", with_(*FIELD_LABELS) + "SELECT timestep, label, count(*) AS cnt FROM labelled GROUP BY ALL")
def cluster_sizes(spark, sf):
    f = views.field(spark, sf)
    return histogram.cluster_sizes(assign(f, ["u"], midpoint_centres(f, ["u"], K, TS), K, TS), TS)


@query(
    "d15_sparsity",
    with_(LINE_ITEMS)
    + "SELECT round(1 - sum(CAST(abs(discount) > 1e-6 AS INT) + CAST(abs(tax) > 1e-6 AS INT)) / (count(*) * 2), 9) AS sparsity FROM li",
)
def sparsity(spark, sf):
    return profile.sparsity(views.line_items(spark, sf), ["discount", "tax"]).select(rounded("sparsity", 9))


@query(
    "d16_column_stats",
    with_(LINE_ITEMS)
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS lo, round(avg({c}), 4) AS mean, max({c}) AS hi FROM li" for c in LI),
)
def column_stats(spark, sf):
    return profile.column_stats(views.line_items(spark, sf), LI).withColumn("mean", F.round("mean", 4))


@query(
    "d17_dataset_profile",
    with_(FIELD)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, (SELECT count(*) FROM field) AS n, 8 * (SELECT count(*) FROM field) AS bytes, "
        f"(SELECT list(CAST({c} AS DOUBLE) ORDER BY timestep, point_id) FROM (SELECT * FROM field ORDER BY timestep, point_id LIMIT 3)) AS head"
        for c, t in (("u", "double"), ("v", "double"), ("gz", "bigint"))
    ),
)
def dataset_profile(spark, sf):
    return profile.dataset_profile(views.field(spark, sf), ["timestep", "point_id"], ["u", "v", "gz"])


@query(
    "d18_train_test_histograms",
    with_(
        FIELD,
        """seqs AS (SELECT cube, row_number() OVER (ORDER BY cube) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT gx // 5 + 2 * (gz // 5) AS cube FROM field))""",
        """tagged AS (SELECT CASE WHEN r >= n - ceil(n * CAST(0.25 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split, u, v FROM field JOIN seqs ON cube = gx // 5 + 2 * (gz // 5))""",
        """vals AS (SELECT split, 'u' AS "column", u AS value FROM tagged UNION ALL SELECT split, 'v', v FROM tagged)""",
        'vl AS (SELECT split, "column", min(value) AS lo, max(value) AS hi FROM vals GROUP BY ALL)',
        f'vc AS (SELECT split, "column", {bin_of("value", "lo", "hi", 50)} AS bin, count(*) AS cnt FROM vals JOIN vl USING (split, "column") GROUP BY ALL)',
    )
    + """SELECT split, "column", b.bin, coalesce(cnt, 0) AS cnt FROM vl CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range(50)) b LEFT JOIN vc USING (split, "column", bin)""",
)
def train_test_histograms(spark, sf):
    f = views.field(spark, sf).withColumn("cube_id", grid.int_div("gx", 5) + 2 * grid.int_div("gz", 5))
    return histogram.column_histograms(ordered_split(f, ["cube_id"], 0.25), ["u", "v"], 50, "split")


@query(
    "d19_padded_limits",
    with_(LINE_ITEMS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(min({c}) - CAST(0.05 AS DOUBLE) * (max({c}) - min({c})), 6) AS lo, round(max({c}) + CAST(0.05 AS DOUBLE) * (max({c}) - min({c})), 6) AS hi FROM li"
        for c in LI
    ),
)
def padded_limits(spark, sf):
    return profile.padded_limits(views.line_items(spark, sf), LI).select("column", rounded("lo"), rounded("hi"))


@query("d20_mean_squared_error", f"WITH {PREDICTIONS} SELECT round(avg((y - yhat) * (y - yhat)), 2) AS mse FROM predictions")
def mean_squared_error(spark, sf):
    return evaluate.mean_squared_error(views.predictions(spark, sf)).select(rounded("mse", 2))


@query("d21_absolute_errors", f"WITH {PREDICTIONS} SELECT timestep, point_id, round(abs(yhat - y) / 32, 9) AS error FROM predictions")
def absolute_errors(spark, sf):
    return evaluate.absolute_errors(views.predictions(spark, sf), ["timestep", "point_id"], 32).withColumn("error", F.round("error", 9))


@query(
    "d22_parity_limits",
    f"WITH {PREDICTIONS} SELECT 'y' AS output, round(min(least(y, yhat)), 4) AS lo, round(max(greatest(y, yhat)), 4) AS hi FROM predictions",
)
def parity_limits(spark, sf):
    return evaluate.parity_limits(views.predictions(spark, sf), [("y", "yhat")]).select("output", rounded("lo", 4), rounded("hi", 4))


def _used(names: tuple[str, ...]) -> str:
    return " + ".join(f"coalesce(b.{n} - a.{n}, 0)" for n in names)


NODES = (
    SNAPSHOTS,
    """ends AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY "timestamp", phase) AS f,
row_number() OVER (PARTITION BY node_id ORDER BY "timestamp" DESC, phase DESC) AS l FROM snapshots)""",
    f"""nodes AS (SELECT a.node_id, a."timestamp" AS started, b."timestamp" AS ended, {_used(('CPU', 'Mem'))} AS cpu_joules,
{_used(('Accel0', 'Accel1', 'Accel2', 'Accel3'))} AS gpu_joules, b."timestamp" - a."timestamp" AS elapsed
FROM (SELECT * FROM ends WHERE f = 1) a JOIN (SELECT * FROM ends WHERE l = 1) b USING (node_id))""",
)


@query(
    "d23_node_energy",
    with_(*NODES)
    + """SELECT node_id, elapsed, round(cpu_joules, 3) AS cpu_joules, round(gpu_joules, 3) AS gpu_joules, round(cpu_joules + gpu_joules, 3) AS joules,
round(CASE WHEN elapsed > 0 THEN (cpu_joules + gpu_joules) / elapsed END, 3) AS watts FROM nodes""",
)
def node_energies(spark, sf):
    nodes = node_energy(views.snapshots(spark, sf))
    return nodes.select("node_id", "elapsed", *[rounded(c, 3) for c in ("cpu_joules", "gpu_joules", "joules", "watts")])


@query(
    "d24_job_energy",
    with_(*NODES)
    + """SELECT round(sum(cpu_joules + gpu_joules), 1) AS joules, round(sum(cpu_joules), 1) AS cpu_joules, round(sum(gpu_joules), 1) AS gpu_joules,
max(ended) - min(started) AS elapsed, round(sum(cpu_joules + gpu_joules) / (max(ended) - min(started)), 4) AS watts FROM nodes""",
)
def job_energies(spark, sf):
    total = job_energy(node_energy(views.snapshots(spark, sf)))
    return total.select(*[rounded(c, 1) for c in ("joules", "cpu_joules", "gpu_joules")], "elapsed", rounded("watts", 4))

