"""Bins, histograms, divergences, clusters, scalers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellsift.functions.bins import bin_index
from cellsift.operators import boxes, cluster, divergence, evaluate, histogram, samplers, scaling

TS = ["timestep"]


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 10.0], [4.0, 4.0, 4.0], [-1.5, 0.0, 2.25, 2.25, 7.0]])
def test_bins_are_those_of_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    lo, hi = min(values), max(values)
    got = [r[0] for r in df.select(bin_index(F.col("v"), F.lit(lo), F.lit(hi), 7)).collect()]
    want, _ = np.histogram(values, bins=7, range=(lo, hi))
    assert list(np.bincount(got, minlength=7)) == list(want)


def _labelled(cloud):
    return cluster.assign(cloud, ["x", "y"], cluster.midpoint_centres(cloud, ["x", "y"], 4, TS), 4, TS)


def _probabilities(pdf, k, bins, cols):
    values = pdf[cols].to_numpy()
    rng = (values.min(), values.max())
    out = []
    for i in range(k):
        counts, _ = np.histogram(pdf[pdf.label == i][cols].to_numpy().ravel(), bins=bins, range=rng)
        p = (counts / counts.sum() if counts.sum() else counts * 0.0) + 1e-10
        out.append(p / p.sum())
    return np.array(out)


def test_strengths_are_the_sums_of_the_matrix(cloud):
    rows = _labelled(cloud)
    dists = histogram.distributions(histogram.cluster_histogram(rows, ["x", "y"], 4, 10, TS), TS, normalised=True)
    matrix = divergence.kl_matrix(dists, TS).toPandas()
    out_s, in_s = divergence.out_strengths(dists, TS).toPandas(), divergence.in_strengths(dists, TS).toPandas()
    for t, pdf in rows.toPandas().groupby("timestep"):
        p = _probabilities(pdf, 4, 10, ["x", "y"])
        kl = np.array([[np.sum(a * np.log(a / b)) for b in p] for a in p])
        mine = matrix[matrix.timestep == t].pivot(index="i", columns="j", values="kl").to_numpy()
        assert np.allclose(mine, kl)
        assert np.allclose(out_s[out_s.timestep == t].sort_values("label").strength, kl.sum(axis=1))
        assert np.allclose(in_s[in_s.timestep == t].sort_values("label").strength, kl.sum(axis=0))


def test_an_empty_cluster_keeps_zeros(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 2, 9.0)], "timestep long, label long, x double")
    hist = histogram.cluster_histogram(rows, ["x"], 3, 4, TS)
    p = histogram.distributions(hist, TS).where("label = 1").agg(F.sum("p"), F.sum("cnt")).first()
    assert p[1] == 0 and p[0] == pytest.approx(4e-10)


def test_lloyd_is_lloyd(cloud):
    centres = cluster.lloyd(cloud, ["x", "y"], 3, TS, 4)
    got = {r["timestep"]: np.array(r["centres"]) for r in centres.collect()}
    for t, pdf in cloud.toPandas().groupby("timestep"):
        x = pdf[["x", "y"]].to_numpy()
        lo, hi = x.min(axis=0), x.max(axis=0)
        c = np.array([lo + (hi - lo) * (i + 0.5) / 3 for i in range(3)])
        for _ in range(4):
            label = ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(3)])
        assert np.allclose(got[t], c[np.lexsort((c[:, 1], c[:, 0]))])


def test_spark_kmeans_gives_sorted_centres(cloud):
    found = cluster.spark_kmeans(cloud.where("timestep = 1"), ["x", "y"], 3, seed=1).first()["centres"]
    assert len(found) == 3 and found == sorted(found)


def test_maxent_needs_two_clusters(cloud):
    with pytest.raises(ValueError):
        samplers.maxent(cloud, 5, cluster_cols=["x"], k=1)


def test_density_and_kernel(cloud):
    d = histogram.density_histogram(cloud, "x", 21, TS).toPandas()
    k = evaluate.density_estimate(cloud, "x", 21, TS).toPandas()
    for t, pdf in cloud.toPandas().groupby("timestep"):
        edges = np.linspace(pdf.x.min(), pdf.x.max(), 21)
        want, _ = np.histogram(pdf.x, bins=edges, density=True)
        assert np.allclose(d[d.timestep == t].sort_values("bin").density, want)
        assert d[d.timestep == t].area.sum() == pytest.approx(1.0)
        h = len(pdf) ** -0.2 * pdf.x.std(ddof=1)
        kde = np.exp(-0.5 * ((edges[:, None] - pdf.x.to_numpy()) / h) ** 2).sum(axis=1) / (len(pdf) * h * np.sqrt(2 * np.pi))
        assert np.allclose(k[k.timestep == t].sort_values("grid").density, kde)


def test_zero_totals_are_drawn_uniformly(spark):
    totals = spark.createDataFrame([(t, i, 0, 0, 0.0 if t == 0 else float(i)) for t in (0, 1) for i in range(6)], "timestep long, ix long, iy long, iz long, total double")
    got = boxes.draw_scored(totals, 3, TS).toPandas()
    assert (got.groupby("timestep").size() == 3).all()
    assert 0 not in set(got[got.timestep == 1].ix)
    assert boxes.draw_scored(totals, 99, TS).count() == 12


def test_scalers(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(1.5, 4.0, 500)
    df = spark.createDataFrame([(float(v), 2.5) for v in x], "a double, c double")
    std = scaling.fit("StandardScaler", df, ["a", "c"]).transform(df).toPandas()
    assert np.allclose(sorted(std.a), sorted((x - x.mean()) / x.std())) and (std.c == 0).all()
    mm = scaling.fit("MinMaxScaler", df, ["a", "c"]).transform(df).toPandas()
    assert mm.a.min() == 0 and mm.a.max() == 1 and (mm.c == 0).all()
    power = scaling.fit("PowerTransformer", df, ["a"])
    got = power.transform(df).toPandas().a

    def likelihood(p):
        y = np.log1p(x) if p == 0 else ((x + 1) ** p - 1) / p
        return -len(x) / 2 * np.log(y.var()) + (p - 1) * np.log1p(x).sum()

    grid = np.linspace(-2, 3, 5001)
    best = grid[np.argmax([likelihood(p) for p in grid])]
    assert power.constants["a"][0] == pytest.approx(best, abs=0.01)
    assert got.mean() == pytest.approx(0, abs=1e-9) and got.std(ddof=0) == pytest.approx(1)
    with pytest.raises(ValueError):
        scaling.fit("Other", df, ["a"])


def test_starts_find_a_small_cluster(spark):
    rng = np.random.default_rng(5)
    blobs = [rng.normal(m, 1.0, (n, 2)) for m, n in (((0, 0), 60_000), ((30, 0), 30_000), ((0, 30), 9_980), ((400, 400), 20))]
    x = np.vstack(blobs)
    df = spark.createDataFrame(pd.DataFrame({"timestep": 1, "point_id": range(len(x)), "x": x[:, 0], "y": x[:, 1]})).repartition(5).cache()
    found = cluster.parallel_centres(df, ["x", "y"], 4, ["point_id"], TS)
    centres = np.array(cluster.lloyd(df, ["x", "y"], 4, TS, 10, found, tolerance=1e-6).first()["centres"])
    inertia = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert inertia(centres) <= 1.05 * inertia(np.array([b.mean(axis=0) for b in blobs]))
    again = cluster.parallel_centres(df.repartition(9), ["x", "y"], 4, ["point_id"], TS)
    assert np.allclose(again.first()["centres"], found.first()["centres"])


def test_starts_of_odd_groups(spark, monkeypatch):
    rows = [(0, i, 2.0) for i in range(9)] + [(1, 0, None), (1, 1, float("nan"))] + [(2, i, float(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "timestep long, point_id long, x double")
    want = {0: [[2.0]] * 3, 2: [[0.0], [1.0], [2.0]]}
    assert {r[0]: r[1] for r in cluster.parallel_centres(df, ["x"], 3, ["point_id"], TS).collect()} == want
    monkeypatch.setattr(cluster, "SENT_VALUES", 0)
    assert {r[0]: r[1] for r in cluster.parallel_centres(df, ["x"], 3, ["point_id"], TS).collect()} == want
    assert cluster.parallel_centres(df.where("timestep = 2").drop("timestep"), ["x"], 3, ["point_id"], []).first()["centres"] == want[2]
    assert cluster.parallel_centres(df.where("timestep > 5"), ["x"], 3, ["point_id"], TS).count() == 0


def test_rounds_end_when_centres_rest(spark, monkeypatch):
    df = spark.createDataFrame([(0, float(v)) for v in (0, 1, 10, 11)], "timestep long, x double")
    calls, plain = [], cluster.assign
    monkeypatch.setattr(cluster, "assign", lambda *a: calls.append(1) or plain(*a))
    assert cluster.lloyd(df, ["x"], 2, TS, 50, tolerance=0.0).first()["centres"] == [[0.5], [10.5]]
    assert len(calls) == 2


def test_kernel_density_keeps_its_bound(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_cauchy(3000), [1e4, -1e4], np.full(500, 2.5)])
    df = spark.createDataFrame([(0, float(v)) for v in x] + [(0, None), (1, 3.0), (2, 4.0), (2, 4.0), (3, None)], "timestep long, x double")
    got = evaluate.density_estimate(df, "x", 33, TS).toPandas().sort_values(["timestep", "grid"])
    at = np.linspace(x.min(), x.max(), 33)
    h = len(x) ** -0.2 * x.std(ddof=1)
    want = np.exp(-0.5 * ((at[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    off = np.abs(got[got.timestep == 0].density.to_numpy() - want) * h * np.sqrt(2 * np.pi)
    assert off.max() < 1.4e-12
    assert got[got.timestep > 0].density.isna().all() and set(got.timestep) == {0, 1, 2}


@pytest.mark.parametrize("kind", ["gamma", "normal", "lognormal", "large", "left"])
def test_power_is_the_peak_in_few_scans(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = {
        "gamma": rng.gamma(1.5, 4.0, 400), "normal": rng.normal(1.0, 2.0, 400), "lognormal": rng.lognormal(1.0, 1.5, 400),
        "large": rng.gamma(2.0, 1e5, 400), "left": -rng.gamma(1.2, 3.0, 400),
    }[kind]
    df = spark.createDataFrame([(float(v), 7.0, None) for v in x], "a double, c double, e double").cache()
    scans, plain = [], scaling._likelihoods
    monkeypatch.setattr(scaling, "_likelihoods", lambda *a: scans.append(1) or plain(*a))
    constants = scaling.fit_power(df, ["a", "c", "e"]).constants
    power = constants["a"][0]

    def likelihood(p):
        up, down = np.where(x >= 0, x, 0), np.where(x < 0, -x, 0)
        y = np.where(x >= 0, ((up + 1) ** p - 1) / p, -((down + 1) ** (2 - p) - 1) / (2 - p))
        return -np.log(y.var()) / 2 + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).mean()

    slope = lambda p: (likelihood(p + 1e-4) - likelihood(p - 1e-4)) / 2e-4
    bend = (slope(power + 1e-3) - slope(power - 1e-3)) / 2e-3
    assert bend < 0 and abs(slope(power) / bend) < 1e-6  # one Newton step moves it by less
    assert len(scans) <= 3
    assert constants["c"][0] == constants["e"][0] == 1.0
