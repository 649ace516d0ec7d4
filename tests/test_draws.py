"""Draws, ranks and samplers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsift import session
from cellsift.operators import draw as draws
from cellsift.operators import samplers
from cellsift.operators.rank import global_rank, stratum
from cellsift.functions.scalars import latin_design

TS = ["timestep"]


def ids(df, col="point_id"):
    return sorted((r["timestep"], r[col]) for r in df.select("timestep", col).collect())


def test_draw_size_membership_and_no_repeats(cloud):
    got = ids(draws.draw(cloud, 40, ["point_id"], TS, seed=1))
    assert len(got) == len(set(got)) == 120
    assert set(got) <= set(ids(cloud))


def test_draw_does_not_depend_on_partitioning(cloud):
    one = ids(draws.draw(cloud.coalesce(1), 25, ["point_id"], TS, weight="w", seed=3))
    many = ids(draws.draw(cloud.repartition(13), 25, ["point_id"], TS, weight="w", seed=3))
    assert one == many


def test_draw_equals_a_full_sort(cloud):
    key = draws.race_key(draws.uniform_key(["timestep", "point_id"], 3), F.col("w"))
    pdf = cloud.withColumn("k", key).toPandas()
    want = pdf.sort_values("k").groupby("timestep").head(57)
    got = ids(draws.draw(cloud, 57, ["point_id"], TS, weight="w", seed=3))
    assert got == sorted(zip(want.timestep, want.point_id))


def test_draw_of_everything_and_of_too_many(cloud):
    assert len(ids(draws.draw(cloud.where("timestep = 2"), 60, ["point_id"], TS))) == 60
    with pytest.raises(Exception, match="asked of a group"):
        draws.draw(cloud, 61, ["point_id"], TS).count()
    assert draws.draw(cloud, 61, ["point_id"], TS, short="all").count() == 61 + 61 + 60


def test_only_positive_weights_are_drawn(cloud):
    zero = cloud.withColumn("w", F.when(F.col("point_id") % 2 == 0, 0.0).otherwise(1.0))
    assert all(p % 2 for _, p in ids(draws.draw(zero, 20, ["point_id"], TS, weight="w")))


def test_inclusion_follows_the_weights(spark):
    weights = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.range(4000).select(
        F.col("id").alias("timestep"), F.explode(F.array(*[F.struct(F.lit(i).alias("point_id"), F.lit(w).alias("w")) for i, w in enumerate(weights)])).alias("e")
    ).select("timestep", "e.*")
    counts = {r["point_id"]: r["count"] for r in draws.draw(df, 2, ["point_id"], TS, weight="w").groupBy("point_id").count().collect()}
    got = np.array([counts[i] for i in range(5)]) / 4000
    rng = np.random.default_rng(0)
    p = np.array(weights) / sum(weights)
    want = np.zeros(5)
    for _ in range(4000):
        want[rng.choice(5, 2, replace=False, p=p)] += 1
    assert np.abs(got - want / 4000).max() < 0.04


def test_rank_with_a_hot_value(cloud):
    pdf = cloud.toPandas().sort_values(["timestep", "x", "point_id"])
    pdf["rank"] = pdf.groupby("timestep").cumcount()
    got = global_rank(cloud, ["x", "point_id"], TS, "rank", size="n").toPandas()
    merged = got.merge(pdf, on=["timestep", "point_id"])
    assert (merged["rank_x"] == merged["rank_y"]).all() and len(merged) == len(pdf)
    assert set(got.groupby("timestep")["n"].first()) == {900, 120, 60}


@pytest.mark.parametrize("size,n", [(10, 3), (11, 4), (12, 12), (7, 5), (100, 7)])
def test_strata_are_those_of_array_split(spark, size, n):
    got = [r[0] for r in spark.range(size).select(stratum(F.col("id"), F.lit(size), n)).collect()]
    want = [i for i, part in enumerate(np.array_split(np.arange(size), n)) for _ in part]
    assert sorted(got) == want


def test_stratified_takes_one_of_each_stratum(cloud):
    picked = samplers.stratified(cloud, 11, feature_cols=["x"], seed=2).toPandas()
    assert len(picked) == 33
    for t, part in cloud.toPandas().groupby("timestep"):
        ordered = part.sort_values(["x", "point_id"]).point_id.to_numpy()
        for s, group in enumerate(np.array_split(ordered, 11)):
            assert picked[(picked.timestep == t) & (picked.stratum == s)].point_id.iloc[0] in group
    with pytest.raises(Exception, match="strata were asked"):
        samplers.stratified(cloud, 61, feature_cols=["x"]).count()


def test_phase_space_draws_do_not_depend_on_the_slices(cloud):
    run = lambda rows: sorted(
        (r["timestep"], r["draw_id"], r["point_id"])
        for r in samplers.phase_space(cloud, 30, feature_cols=["x", "y"], seed=5, chunk_rows=rows).collect()
    )
    whole = run(10**6)
    assert whole == run(7) and len(whole) == 90


def test_phase_space_is_flat_over_bins(cloud):
    got = samplers.phase_space(cloud, 2000, feature_cols=["x"], seed=1, bins=4).toPandas()
    share = got[got.timestep == 0].groupby("bin_id").size() / 2000
    assert abs(share - 1 / len(share)).max() < 0.05


def brute_latin(pdf, design, cols):
    taken, out = set(), []
    pdf = pdf.sort_values("point_id")
    for d in design.sort_values("design_id").itertuples():
        lo, hi = pdf[cols].min().to_numpy(), pdf[cols].max().to_numpy()
        at = lo + np.array([d.d0, d.d1]) * (hi - lo)
        gap = pdf[cols].to_numpy() - at
        dist = np.sqrt((gap**2).sum(axis=1))
        order = np.argsort(dist, kind="stable")
        pick = next(pdf.point_id.iloc[i] for i in order if pdf.point_id.iloc[i] not in taken)
        taken.add(pick)
        out.append((d.design_id, pick))
    return out


@pytest.mark.parametrize("keep,chunk_rows,design_rows", [(1, 50, 0), (8, 10**6, 0), (1, 50, 10**6), (8, 50, 10**6)])
def test_latin_hypercube_is_the_greedy_choice(spark, cloud, keep, chunk_rows, design_rows):
    picked = samplers.latin_hypercube(
        cloud, 25, feature_cols=["x", "y"], seed=4, keep=keep, chunk_rows=chunk_rows, design_rows=design_rows
    ).toPandas()
    design = latin_design(spark, cloud, 25, 2, TS, 4).toPandas()
    for axis in ("d0", "d1"):
        for _, part in design.groupby("timestep"):
            assert sorted((part[axis] * 25).astype(int)) == list(range(25))
    for t, part in cloud.toPandas().groupby("timestep"):
        want = brute_latin(part, design[design.timestep == t], ["x", "y"])
        mine = picked[picked.timestep == t].sort_values("design_id")
        assert list(zip(mine.design_id, mine.point_id)) == want
    with pytest.raises(Exception, match="design points were asked"):
        samplers.latin_hypercube(cloud, 61, feature_cols=["x", "y"]).count()


def test_every_join_also_works_without_a_broadcast(cloud, monkeypatch):
    names = {"maxent": dict(cluster_cols=["x"], k=3, rounds=2), "random": {}, "uips": {}, "lhs": {}, "stratified": {}}
    run = lambda: {
        n: ids(f(cloud, 12, feature_cols=["x", "y"], seed=9, **o)) for n, o in names.items() for f in [samplers.SAMPLERS[n]]
    }
    small = run()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert run() == small
    assert all(len(v) == 36 for v in small.values())


def test_top_up_rows(cloud):
    chosen = draws.draw(cloud, 10, ["point_id"], TS)
    rest = draws.not_yet_chosen(cloud, chosen, ["timestep", "point_id"])
    assert rest.count() == 1080 - 30
    assert not set(ids(rest)) & set(ids(chosen))


@pytest.mark.parametrize("n,keep,block,rows", [(40, 4, 13, 50), (55, 16, 1000, 60)])
def test_hypercube_blocks_agree(spark, cloud, monkeypatch, n, keep, block, rows):
    """Blocks that contend for the same rows end with the greedy choice, with cells
    of few rows and lists that run out, and with half a group at one value."""
    from cellsift.operators import hypercube

    monkeypatch.setattr(hypercube, "CELL_ROWS", rows)
    monkeypatch.setattr(hypercube, "PATIENCE", 3)
    picked = samplers.latin_hypercube(cloud, n, feature_cols=["x", "y"], seed=8, keep=keep, block=block, chunk_rows=30).toPandas()
    design = latin_design(spark, cloud, n, 2, TS, 8).toPandas()
    for t, part in cloud.toPandas().groupby("timestep"):
        mine = picked[picked.timestep == t].sort_values("design_id")
        assert list(zip(mine.design_id, mine.point_id)) == brute_latin(part, design[design.timestep == t], ["x", "y"])


def test_hypercube_cells_hold_the_nearest():
    from cellsift.operators import hypercube

    rng = np.random.default_rng(5)
    x = rng.random((3000, 3)) ** 3
    cell = (x * 6).astype(int) @ [36, 6, 1]
    names = np.unique(cell)
    low, high = (np.array([f(x[cell == c], axis=0) for c in names]) for f in (np.min, np.max))
    targets = rng.random((50, 3))
    of, at = hypercube._visits(low, high, np.array([(cell == c).sum() for c in names]), targets, 5)
    for i, t in enumerate(targets):
        near = np.argsort(((x - t) ** 2).sum(axis=1))[:5]
        assert set(cell[near]) <= set(names[at[of == i]])
    assert len(of) < 50 * len(names) / 3


def test_phase_space_in_twenty_dimensions(spark):
    rng = np.random.default_rng(2)
    cols = [f"c{i}" for i in range(20)]
    corner = rng.integers(0, 2, (40, 20))
    data = corner[rng.integers(0, 40, 600)] * 0.8 + rng.random((600, 20)) * 0.05
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(data)], "timestep long, point_id long, " + ", ".join(f"{c} double" for c in cols))
    got = samplers.phase_space(df, 300, feature_cols=cols, seed=1).toPandas()
    assert len(got) == 300 and set(got.point_id) <= set(range(600)) and list(got.columns)[:2] == ["timestep", "point_id"]
    span = data.max(axis=0) - data.min(axis=0)
    want = np.minimum((data - data.min(axis=0)) / span * 10, 9).astype(int)
    assert all(list(r.bin_id) == want[r.point_id].tolist() for r in got.itertuples())
