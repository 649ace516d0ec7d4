"""Clustering, scaling and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsift.functions import grid
from cellsift.operators import scaling
from cellsift.operators.cluster import assign, drawn_centres, lloyd, parallel_centres
from cellsift.plans import views
from cellsift.plans.catalog import query, rounded
from cellsift.plans.sqltext import labelled, midpoints, moved, race, with_
from cellsift.params import CurationParams
from cellsift.plans.curate import curate
from cellsift.plans.training import training_job, training_table
from cellsift.plans.views import CLOUD, FIELD, LINE_ITEMS

TS = ["timestep"]
LI = ["quantity", "price", "discount", "tax"]
ROUNDS, K = 3, 4


def lloyd_ctes(view: str, cols: list[str], k: int, rounds: int) -> list[str]:
    out = [midpoints(view, cols, k, "cent0")]
    for i in range(rounds):
        out.append(labelled(view, cols, k, f"lab{i}", f"cent{i}"))
        out.append(moved(f"lab{i}", cols, k, f"cent{i + 1}", f"cent{i}"))
    return out


@query(
    "j11_kmeans_centres",
    with_(CLOUD, *lloyd_ctes("cloud", ["x0", "x1"], K, ROUNDS))
    + "SELECT timestep, row_number() OVER (PARTITION BY timestep ORDER BY a, b) - 1 AS label, round(a, 9) AS a, round(b, 9) AS b FROM ("
    + " UNION ALL ".join(f"SELECT timestep, c{i}_0 AS a, c{i}_1 AS b FROM cent{ROUNDS}" for i in range(K))
    + ")",
)
def kmeans_centres(spark, sf):
    centres = lloyd(views.cloud(spark, sf), ["x0", "x1"], K, TS, ROUNDS)
    one = centres.select("timestep", F.posexplode("centres").alias("label", "c"))
    return one.select("timestep", F.col("label").cast("long"), F.round(F.col("c")[0], 9).alias("a"), F.round(F.col("c")[1], 9).alias("b"))


@query("j11_kmeans_labels", with_(FIELD, *lloyd_ctes("field", ["u"], K, 2), labelled("field", ["u"], K, "final", "cent2")) + "SELECT timestep, point_id, label FROM final")
def kmeans_labels(spark, sf):
    f = views.field(spark, sf)
    return assign(f, ["u"], lloyd(f, ["u"], K, TS, 2), K, TS).select("timestep", "point_id", "label")


@query("j11_kmeans_parallel_starts")
def kmeans_parallel_starts(spark, sf):
    """Starts by rounds of oversampling over all rows, then rounds of k-means until no
    centre moves: sizes of the clusters."""
    v, cols = views.vectors(spark, sf), views.COMPONENTS
    centres = lloyd(v, cols, 5, TS, 10, parallel_centres(v, cols, 5, ["point_id"], TS), tolerance=1e-9)
    return assign(v, cols, centres, 5, TS).groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))


STARTS = f"""cent0 AS (SELECT timestep, {', '.join(f'list(u ORDER BY u)[{i + 1}] AS c{i}_0' for i in range(K))} FROM (SELECT timestep, u, row_number() OVER
(PARTITION BY timestep ORDER BY {race(['timestep', 'point_id'], 'centres-1')}, point_id) AS n FROM field) WHERE n <= {K} GROUP BY timestep)"""


@query(
    "j12_kmeans_drawn_starts",
    with_(FIELD, STARTS, *lloyd_ctes("field", ["u"], K, 4)[1:])
    + "SELECT timestep, row_number() OVER (PARTITION BY timestep ORDER BY c) - 1 AS label, round(c, 4) AS centre FROM ("
    + " UNION ALL ".join(f"SELECT timestep, c{i}_0 AS c FROM cent4" for i in range(K))
    + ")",
)
def kmeans_drawn_starts(spark, sf):
    """Distributed k-means of every timestep from seeded starts, true means."""
    f = views.field(spark, sf)
    centres = lloyd(f, ["u"], K, TS, 4, drawn_centres(f, ["u"], K, ["point_id"], TS, seed=1))
    one = centres.select("timestep", F.posexplode("centres").alias("label", "c"))
    return one.select("timestep", F.col("label").cast("long"), F.round(F.col("c")[0], 4).alias("centre"))


SPLIT = "parts AS (SELECT *, CASE WHEN timestep >= (SELECT max(timestep) FROM li) - 1 THEN 'test' ELSE 'train' END AS split FROM li)"


def _parts(spark, sf):
    li = views.line_items(spark, sf)
    last = li.agg(F.max("timestep")).first()[0]
    return li.withColumn("split", F.when(F.col("timestep") >= last - 1, "test").otherwise("train"))


def _profile_sql(cols: list[str], expression) -> str:
    aggs = ", ".join(f"round(sum({expression(c)}), 3) AS s_{c}, round(min({expression(c)}), 6) AS lo_{c}, round(max({expression(c)}), 6) AS hi_{c}" for c in cols)
    return f"SELECT split, timestep, count(*) AS n, {aggs} FROM parts CROSS JOIN fit GROUP BY split, timestep"


def _profile(df, cols):
    aggs = []
    for c in cols:
        aggs += [F.round(F.sum(c), 3).alias(f"s_{c}"), F.round(F.min(c), 6).alias(f"lo_{c}"), F.round(F.max(c), 6).alias(f"hi_{c}")]
    return df.groupBy("split", "timestep").agg(F.count(F.lit(1)).alias("n"), *aggs)


def _fitted(spark, sf, kind, cols):
    parts = _parts(spark, sf)
    return _profile(scaling.fit(kind, parts.where(F.col("split") == "train"), cols).transform(parts), cols)


@query(
    "j13_standard_scaling",
    with_(LINE_ITEMS, SPLIT, "fit AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in LI) + " FROM parts WHERE split = 'train')")
    + _profile_sql(LI, lambda c: f"(({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END)"),
)
def standard_scaling(spark, sf):
    return _fitted(spark, sf, "StandardScaler", LI)


@query(
    "j14_minmax_scaling",
    with_(LINE_ITEMS, SPLIT, "fit AS (SELECT " + ", ".join(f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in LI) + " FROM parts WHERE split = 'train')")
    + _profile_sql(LI, lambda c: f"(({c} - a_{c}) / CASE WHEN b_{c} = a_{c} THEN 1 ELSE b_{c} - a_{c} END)"),
)
def minmax_scaling(spark, sf):
    return _fitted(spark, sf, "MinMaxScaler", LI)


def yj_sql(x: str, power: float) -> str:
    up = f"ln(1 + {x})" if power == 0 else f"((pow({x} + 1, CAST({power} AS DOUBLE)) - 1) / CAST({power} AS DOUBLE))"
    rest = 2 - power
    down = f"(-ln(1 - {x}))" if rest == 0 else f"(-(pow(1 - {x}, CAST({rest} AS DOUBLE)) - 1) / CAST({rest} AS DOUBLE))"
    return f"(CASE WHEN {x} >= 0 THEN {up} ELSE {down} END)"


POWERS = (-0.5, 0.0, 0.5, 1.0, 2.0)


@query(
    "j15_power_transform",
    with_(CLOUD)
    + "SELECT point_id, "
    + ", ".join(f"round({yj_sql('(x0 - x1) / 100', p)}, 10) AS y{i}" for i, p in enumerate(POWERS))
    + " FROM cloud",
)
def power_transform(spark, sf):
    c = views.cloud(spark, sf).withColumn("z", (F.col("x0") - F.col("x1")) / 100)
    return c.select("point_id", *[rounded(scaling.yeo_johnson(F.col("z"), p), 10, f"y{i}") for i, p in enumerate(POWERS)])


@query(
    "j15_power_likelihood",
    with_(CLOUD, "z AS (SELECT x0 / 50 AS z FROM cloud)")
    + " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS power, round(-count(*) / 2.0::DOUBLE * ln(var_pop({yj_sql('z', p)})) + CAST({p - 1} AS DOUBLE) * sum(sign(z) * ln(1 + abs(z))), 3) AS likelihood FROM z"
        for p in POWERS
    ),
)
def power_likelihood(spark, sf):
    z = views.cloud(spark, sf).select((F.col("x0") / 50).alias("z"))
    return scaling.power_moments(z, "z", POWERS).select("power", rounded("likelihood", 3))


@query("j15_power_fit")
def power_fit(spark, sf):
    """Fitted power and the standardised column it gives."""
    z = views.cloud(spark, sf).select((F.col("x0") / 50).alias("z"))
    fitted = scaling.fit_power(z, ["z"])
    power = fitted.constants["z"][0]
    return fitted.transform(z).agg(F.lit(power).alias("power"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("deviation"))


SEQ = """rows0 AS (SELECT gx // 5 + 2 * (gz // 5) AS cube_id, s.start, timestep - s.start AS step, point_id, u, v, w FROM field
JOIN (SELECT CAST(range AS BIGINT) AS start FROM range(5)) s ON timestep >= s.start AND timestep < s.start + 2),
seqs AS (SELECT cube_id, start, row_number() OVER (ORDER BY cube_id, start) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT cube_id, start FROM rows0)),
parts AS (SELECT rows0.*, CASE WHEN r >= n - ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM rows0 JOIN seqs USING (cube_id, start)),
fit AS (SELECT min(u) AS ulo, max(u) AS uhi, min(v) AS vlo, max(v) AS vhi, avg(w) AS wm, stddev_pop(w) AS ws FROM parts WHERE split = 'train')"""


def _training(spark, sf):
    f = views.field(spark, sf).withColumn("cube_id", grid.int_div("gx", 5) + 2 * grid.int_div("gz", 5))
    return training_table(f, ["u", "v"], ["w"], 2, 1, 0.2)


@query(
    "j17_training_rows",
    with_(FIELD, SEQ)
    + """SELECT split, cube_id, start, step, point_id, round((u - ulo) / (uhi - ulo), 8) AS u, round((v - vlo) / (vhi - vlo), 8) AS v, round((w - wm) / ws, 6) AS w
FROM parts CROSS JOIN fit""",
)
def training_rows(spark, sf):
    rows = _training(spark, sf).rows
    return rows.select("split", "cube_id", "start", "step", "point_id", rounded("u", 8), rounded("v", 8), rounded("w", 6))


@query(
    "j17_training_packed",
    with_(FIELD, SEQ)
    + """SELECT split, cube_id || ':' || start AS seq_id, CAST(count(*) AS BIGINT) AS slots, round(list((u - ulo) / (uhi - ulo) ORDER BY step, point_id)[7], 8) AS u7,
round(list((w - wm) / ws ORDER BY step, point_id)[-1], 6) AS w_last FROM parts CROSS JOIN fit GROUP BY ALL""",
)
def training_packed(spark, sf):
    packed = _training(spark, sf).packed
    return packed.select(
        "split", "seq_id", F.size("u").cast("long").alias("slots"), F.round(F.element_at("u", 7), 8).alias("u7"),
        F.round(F.element_at("w", -1), 6).alias("w_last"),
    )


BOXED = SEQ.replace("timestep < s.start + 2)", "timestep < s.start + 2 AND gx // 5 + 2 * (gz // 5) < 4)")


@query(
    "j17_training_job",
    with_(FIELD, BOXED)
    + """SELECT split, cube_id || ':' || start AS seq_id, CAST(count(*) AS BIGINT) AS slots, round(list((u - ulo) / (uhi - ulo) ORDER BY step, point_id)[7], 8) AS u7,
round(list((w - wm) / ws ORDER BY step, point_id)[-1], 6) AS w_last FROM parts CROSS JOIN fit GROUP BY ALL""",
)
def training_from_parameters(spark, sf):
    """Curation of whole boxes and its training table, from one set of parameters."""
    f = views.field(spark, sf)
    p = CurationParams(
        nx=views.NX, ny=views.NY, nz=views.depth(f), pad=0, nxsl=5, nysl=5, nzsl=5, hypercubes="uniform", num_hypercubes=4, method="full",
        target="p_full", cluster_var=("u",), input_vars=("u", "v"), output_vars=("w",), window=2, overlap=1, test_frac=0.2,
    )
    packed = training_job(curate(f, p), p).packed
    return packed.select(
        "split", "seq_id", F.size("u").cast("long").alias("slots"), F.round(F.element_at("u", 7), 8).alias("u7"),
        F.round(F.element_at("target_w", -1), 6).alias("w_last"),
    )
