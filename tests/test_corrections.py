"""Cases that the tables of the queries do not hold."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsift import session
from cellsift.operators import cluster, energy, joins, samplers, scaling
from cellsift.params import CurationParams
from cellsift.plans.curate import curate_archive
from cellsift.sinks import tables
from cellsift.sources import formats, rawgrid, tabular


def test_node_without_accelerators(spark):
    rows = [("a", 0.0, "s", 10.0, 10.0, 1.0, 1.0, 1.0, 1.0), ("a", 10.0, "e", 20.0, 20.0, 6.0, 6.0, 6.0, 26.0)]
    rows += [("b", 0.0, "s", 5.0, 5.0, None, None, None, None), ("b", 10.0, "e", 15.0, 15.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "node_id string, timestamp double, phase string, CPU double, Mem double, Accel0 double, Accel1 double, Accel2 double, Accel3 double")
    nodes = energy.node_energy(df)
    assert {r["node_id"]: r["joules"] for r in nodes.collect()} == {"a": 60.0, "b": 20.0}
    job = energy.job_energy(nodes).first()
    assert job["joules"] == job["cpu_joules"] + job["gpu_joules"] == 80.0


def test_alignment_counts_each_variable(spark):
    one = lambda name, rows: spark.createDataFrame(rows, f"k int, {name} double")
    u, v = one("u", [(1, 1.0), (2, 2.0)]), one("v", [(2, 5.0), (3, 6.0)])
    assert [tuple(r) for r in joins.align_variables({"u": u, "v": v}, ["k"]).collect()] == [(2, 2.0, 5.0)]
    with pytest.raises(Exception, match="two rows"):
        joins.align_variables({"u": one("u", [(1, 1.0), (1, 6.0)]), "v": v}, ["k"]).collect()


def test_downsampled_set_is_replaced(spark, tmp_path):
    df = spark.range(10)
    for _ in range(2):
        tables.write_downsampled(df, str(tmp_path / "d"), 10)
    tables.write_downsampled(df.limit(3), str(tmp_path / "d"), 3)
    counts = {r["n_samples"]: r["count"] for r in spark.read.parquet(str(tmp_path / "d")).groupBy("n_samples").count().collect()}
    assert counts == {10: 10, 3: 3}


def test_scratch_folder_must_be_shared():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session)


def test_incomplete_snapshot_is_an_error(spark, tmp_path):
    for name in ("u_0.500000", "v_0.500000", "u_1.500000"):
        np.zeros(8, "<f4").tofile(tmp_path / name)
    read = lambda **more: rawgrid.read_raw_grid(spark, str(tmp_path), ["u", "v"], (2, 2, 2), **more)
    with pytest.raises(Exception, match="skip_incomplete"):
        read().count()
    assert read(skip_incomplete=True).select("timestep").distinct().count() == 1


def test_seeded_centres_fill_every_cluster(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    df = spark.createDataFrame([(0, i, float(a), float(-a + b)) for i, (a, b) in enumerate(zip(x, 0.1 * rng.normal(size=4000)))], "timestep int, point_id int, x double, y double")
    start = cluster.seeded_centres(df, ["x", "y"], 10, ["point_id"], ["timestep"])
    final = cluster.lloyd(df, ["x", "y"], 10, ["timestep"], 10, start)
    sizes = cluster.assign(df, ["x", "y"], final, 10, ["timestep"]).groupBy("label").count().collect()
    assert len(sizes) == 10
    inertia = lambda c: sum(min((a - p) ** 2 + (b - q) ** 2 for p, q in c) for _, _, a, b in df.collect())
    good = cluster.spark_kmeans(df, ["x", "y"], 10, seed=3, max_iter=50).first()["centres"]
    assert inertia(final.first()["centres"]) <= 1.05 * inertia(good)


def test_power_reaches_its_optimum(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.gamma(2.0, 3.0, 600)], "x double")
    power = scaling.fit_power(df, ["x"]).constants["x"][0]
    near = [power - 1e-4, power, power + 1e-4]
    found = scaling._likelihoods(df, {"x": near})["x"]
    assert found[1] >= max(found[0], found[2])


def test_latin_hypercube_needs_a_group(spark):
    with pytest.raises(ValueError, match="group"):
        samplers.latin_hypercube(spark.range(9).withColumn("x", F.col("id") * 1.0), 2, feature_cols=["x"], id_col="id", group_cols=[])


def test_wide_centres_give_the_same_labels(spark):
    rows = [(0, i, *[float((i * (a + 3)) % 11) for a in range(6)]) for i in range(60)] + [(0, 99, None, *[0.0] * 5)]
    cols = [f"c{a}" for a in range(6)]
    df = spark.createDataFrame(rows, "timestep int, id int, " + ", ".join(f"{c} double" for c in cols))
    centres = cluster.midpoint_centres(df, cols, 4, ["timestep"])
    plain = {(r.id, r.label) for r in cluster.assign(df, cols, centres, 4, ["timestep"]).collect()}
    least, most = cluster.PLAIN_VALUES, cluster.SENT_VALUES
    try:
        for cluster.PLAIN_VALUES, cluster.SENT_VALUES in ((0, most), (0, 0)):
            assert {(r.id, r.label) for r in cluster.assign(df, cols, centres, 4, ["timestep"]).collect()} == plain
    finally:
        cluster.PLAIN_VALUES, cluster.SENT_VALUES = least, most


def test_near_ties_are_summed_axis_by_axis():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 64)) + 1e6
    centres = x[:7] + rng.normal(size=(7, 64)) * 1e-9
    x = np.vstack([x, (centres[1] + centres[2]) / 2, np.full(64, np.nan)])
    total = np.zeros((len(x), 7))
    for axis in range(64):
        total += (x[:, axis][:, None] - centres[:, axis]) ** 2
    want = np.where(np.isnan(total[:, 0]), 0, total.argmin(axis=1))
    assert (cluster.nearest_rows(x, centres) == want).all()


def test_files_meet_their_size(spark, tmp_path):
    """A timestep with most rows gets files in proportion, the others one each."""
    df = spark.range(30_000).select(F.when(F.col("id") < 26_000, 7).otherwise(F.col("id") % 5).cast("long").alias("timestep"), "id", (F.col("id") * 0.5).alias("x"))
    tables.write_curated(df.repartition(16), str(tmp_path / "c"), file_bytes=24_000)  # 1,000 rows
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "c").iterdir() if p.is_dir()}
    assert files == {"timestep=7": 26, **{f"timestep={t}": 1 for t in range(5)}}
    assert spark.read.parquet(str(tmp_path / "c")).count() == 30_000


def test_archive_job_with_a_vector_variable(spark, tmp_path):
    n = 4 * 4 * 4
    for name, prefix, parts in (("velocity", "vel", 3), ("pressure", "pressure", 1)):
        prefix = rawgrid.PREFIXES.get(name, name)
        (tmp_path / name).mkdir()
        for t in (1, 2, 3, 4):
            (np.arange(n * parts) + 1000 * t).astype("<f4").tofile(tmp_path / name / f"cube_{prefix}.{t}")
    p = CurationParams(
        nx=4, ny=4, nz=4, nxsl=2, nysl=2, nzsl=2, pad=0, hypercubes="maxent", num_hypercubes=2, method="maxent", num_samples=3, num_clusters=2,
        cluster_var=("pressure",), input_vars=("velocity",), output_vars=("pressure",), target="p",
    )
    rows = curate_archive(spark, str(tmp_path), p, layout="var_dir").inputs.collect()
    assert len(rows) == 4 * 6
    for r in rows:
        cell = (r.gz * 4 + r.gy) * 4 + r.gx
        assert (r.velocity_x, r.velocity_z) == (1000 * r.timestep + 3 * cell, 1000 * r.timestep + 3 * cell + 2)
        assert (round(r.x, 9), round(r.y, 9)) == (round(r.gx / 3, 9), round(r.gy / 3, 9)) and round(r.z, 9) == round(r.gz / 3 * 0.5, 9)
    loaded = formats.load(spark, "cube-dirs", str(tmp_path), replace(p, timesteps=(2.0, 9.0), nxoffset=1, nxskip=2))
    assert {(r.timestep, r.gx) for r in loaded.collect()} == {(2, 1), (2, 3)}
    for t in (1, 3, 4):  # files of other times aren't opened
        (tmp_path / "pressure" / f"cube_{rawgrid.PREFIXES['pressure']}.{t}").write_bytes(b"x")
    assert loaded.count() == 32


def test_csv_takes_files_one_to_n(spark, tmp_path):
    """Files are numbered one by one, whatever the write interval."""
    for t in (1, 2, 3, 4, 100):
        spark.createDataFrame([tuple(float(t) for _ in tabular.CSV_COLUMNS)], ", ".join(f"`{c}` double" for c in tabular.CSV_COLUMNS)).toPandas().to_csv(
            tmp_path / f"cylinder_t{t:04d}.csv", index=False
        )
    steps = lambda **p: sorted(r.timestep for r in formats.load(spark, "csv", str(tmp_path), CurationParams(**p)).collect())
    assert steps() == [1, 2, 3, 4, 100]
    assert steps(num_timesteps=4) == [1, 2, 3, 4]
    assert steps(num_timesteps=2, write_interval=50) == [1, 2]


def test_force_as_of_over_ranges(spark):
    """Ties, ranges without a force and times before the first one."""
    import bisect
    import random

    rng = random.Random(4)
    forces = [(rng.choice([5.0, 5.5, 20.0, rng.uniform(4, 90)]), rng.choice([None, rng.random()])) for _ in range(60)]
    times = [rng.choice([5.0, 5.5, rng.uniform(0, 120)]) for _ in range(300)] + [99.0] * 200
    got = joins.latest_force(spark.createDataFrame([(t,) for t in times], "snapshot double").repartition(7), spark.createDataFrame(forces, "time double, drag double").repartition(5))
    held = sorted(f for f in forces if f[1] is not None)
    want = [(t, held[k - 1][1] if (k := bisect.bisect_right(held, (t, 2.0))) else None) for t in times]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_available_and_requested_joins_distinct_times(spark, tmp_path):
    """Repeats go before the join, so no task holds all rows of a timestep; null times are equal."""
    from cellsift.plans.queries_relational import available_and_requested

    events = [(None if i % 7 == 0 else f"2024-01-{1 + i % 20:02d} 10:00:00", i) for i in range(700)]
    spark.createDataFrame(events, "ts string, event_id long").selectExpr("CAST(ts AS timestamp) AS ts", "event_id", "1.0 AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(None if i % 9 == 0 else i % 8,) for i in range(900)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    got = available_and_requested(spark, str(tmp_path))
    assert sorted([r[0] for r in got.collect()], key=lambda t: -1 if t is None else t) == [None, 0, 2, 4, 6, 8, 10, 12, 14]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan[plan.index("LeftSemi") :].count("Aggregate") == 2
