"""K-means on the cluster variables, every group of rows in the same jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsift.operators.draw import draw
from cellsift.operators.histogram import axis_limits
from cellsift.session import settle, small_side


def midpoint_centres(df: DataFrame, cols: Sequence[str], k: int, group_cols: Sequence[str]) -> DataFrame:
    """Starting centres: middles of ``k`` equal intervals of each column.

    One row per group with ``centres``, an array of k arrays.
    """
    return midpoints_of(axis_limits(df, cols, group_cols), cols, k, group_cols)


def midpoints_of(ranges: DataFrame, cols: Sequence[str], k: int, group_cols: Sequence[str]) -> DataFrame:
    """The same from column limits that are known already."""
    centre = [
        F.array(*[F.col(f"lo_{c}").cast("double") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * F.lit((i + 0.5) / k) for c in cols])
        for i in range(k)
    ]
    return ranges.select(*group_cols, F.array(*centre).alias("centres"))


def drawn_centres(
    df: DataFrame, cols: Sequence[str], k: int, id_cols: Sequence[str], group_cols: Sequence[str], seed: int = 0
) -> DataFrame:
    """Starting centres: ``k`` rows of each group drawn with the seed."""
    picked = draw(df, k, id_cols, group_cols, seed=f"centres-{seed}")
    point = F.array(*[F.col(c).cast("double") for c in cols])
    return picked.groupBy(*group_cols).agg(F.array_sort(F.collect_list(point)).alias("centres"))


def seeded_centres(
    df: DataFrame, cols: Sequence[str], k: int, id_cols: Sequence[str], group_cols: Sequence[str],
    seed: int = 0, starts: int = 20, sample: int = 100,
) -> DataFrame:
    """Starting centres: the best of ``starts`` k-means++ runs on a sample.

    Of each group ``sample`` x k rows are taken, by a hash of their ids, so the
    rows of a group that meet in one task are bounded.  Runs are compared by
    inertia; an empty cluster moves to the row farthest from its centre.
    """
    import pandas as pd

    group, most = list(group_cols), sample * k
    rows = df.select(*group, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)], F.xxhash64(F.lit(seed), *id_cols).alias("_key"))
    counts = settle(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_of")))
    thin = F.shiftrightunsigned("_key", 11) / F.lit(float(1 << 53)) < F.lit(4.0 * most) / F.col("_of")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_key", *[f"_x{i}" for i in range(len(cols))]))
    taken = rows.join(small_side(counts), group).where(thin).withColumn("_place", place).where(F.col("_place") <= most)

    def best(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("_place")[[f"_x{i}" for i in range(len(cols))]].to_numpy()
        rng, found, least = np.random.default_rng(seed), None, np.inf
        apart = lambda c: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        for _ in range(starts):
            c = x[rng.integers(len(x))][None]
            while len(c) < k:
                gap = apart(c).min(axis=1)
                c = np.vstack([c, x[rng.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(x))]])
            for _ in range(10):
                gap = apart(c)
                label = gap.argmin(axis=1)
                for j in range(k):
                    c[j] = x[label == j].mean(axis=0) if (label == j).any() else x[gap.min(axis=1).argmax()]
            inertia = apart(c).min(axis=1).sum()
            if inertia < least:
                found, least = c, inertia
        return pd.DataFrame([(*key, sorted(found.tolist()))], columns=[*group, "centres"])

    schema = ", ".join([*[f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group], "centres array<array<double>>"])
    return taken.groupBy(*group).applyInPandas(best, schema)


def parallel_centres(
    df: DataFrame, cols: Sequence[str], k: int, id_cols: Sequence[str], group_cols: Sequence[str],
    seed: int = 0, rounds: int = 5, oversample: float = 2.0, starts: int = 20,
) -> DataFrame:
    """Starting centres from all rows, by rounds of oversampling.

    Candidates begin with one row of each group. Each round scans twice: for the sum
    of squared distances to the candidates, then for the rows that join them, each with
    probability ``oversample`` x k x its share of that sum, by a hash of its id. So about
    rounds x oversample x k candidates are kept whatever the rows, and a small far cluster
    is found although a sample of rows would miss it. Each candidate weighs
    as many rows as are nearest to it; the weighted candidates of a group become k
    centres in one task, as the best of ``starts`` k-means++ runs by inertia.

    Rows with a missing or infinite value take no part, groups of only such rows give
    no centres. A group with fewer than k different rows has equal centres.
    """
    import pandas as pd

    group, axes = list(group_cols) or ["_all"], [f"_x{i}" for i in range(len(cols))]
    named = df if group_cols else df.withColumn("_all", F.lit(0))
    rows = named.select(
        *group, *[F.col(c).cast("double").alias(x) for c, x in zip(cols, axes)], F.xxhash64(F.lit(seed), *id_cols).alias("_key")
    ).where(" AND ".join(f"abs({x}) < double('infinity')" for x in axes))
    lead = rows.groupBy(*group).agg(F.min_by(F.array(*axes), F.struct("_key", *axes)).alias("_c"))
    found = settle(lead.select(*group, F.array("_c").alias("centres")))
    for i in range(rounds):
        near = _nearest(rows, axes, found, group)
        costs = small_side(near.groupBy(*group).agg(F.sum("_gap").alias("_cost")))
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(i), "_key"), 11) / F.lit(float(1 << 53))
        more = near.join(costs, group).where(chance * F.col("_cost") < F.lit(oversample * k) * F.col("_gap")).select(*group, F.array(*axes).alias("_c"))
        every = found.select(*group, F.explode("centres").alias("_c")).union(more)
        found = settle(every.groupBy(*group).agg(F.array_sort(F.collect_set("_c")).alias("centres")))
    weights = _nearest(rows, axes, found, group).groupBy(*group, "label").agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    listed = found.select(*group, F.posexplode("centres").alias("_at", "_c")).withColumn("label", F.col("_at").cast("long"))

    def reduce(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("label")
        best = best_of_starts(np.array(frame["_c"].tolist()), frame["_weight"].to_numpy(), k, seed, starts)
        return pd.DataFrame([(*key, sorted(best.tolist()))], columns=[*group, "centres"])

    schema = ", ".join([*[f"`{g}` {named.schema[g].dataType.simpleString()}" for g in group], "centres array<array<double>>"])
    return listed.join(weights, [*group, "label"]).groupBy(*group).applyInPandas(reduce, schema).drop("_all")


#: Starts that read the rows, by the name of the parameter.
STARTING = {"seeded": seeded_centres, "parallel": parallel_centres}


def best_of_starts(x: np.ndarray, weight: np.ndarray, k: int, seed: int, starts: int) -> np.ndarray:
    """k centres of weighted points: ten rounds from each of several k-means++
    starts, the least weighted inertia wins. An empty cluster moves to the point
    that costs most."""
    rng, found, least = np.random.default_rng(seed), x[:1].repeat(k, axis=0), np.inf
    middle = np.average(x, axis=0, weights=weight)
    x = x - middle
    size = (x * x).sum(axis=1)
    apart = lambda c: np.maximum(size[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T), 0)
    for _ in range(starts):
        taken = [int(rng.choice(len(x), p=weight / weight.sum()))]
        gap = ((x - x[taken[0]]) ** 2).sum(axis=1)
        while len(taken) < k:
            cost = gap * weight
            taken.append(int(rng.choice(len(x), p=cost / cost.sum()) if cost.sum() > 0 else rng.integers(len(x))))
            gap = np.minimum(gap, ((x - x[taken[-1]]) ** 2).sum(axis=1))
        c = x[taken]
        for _ in range(10):
            gaps = apart(c)
            label, cost = gaps.argmin(axis=1), gaps.min(axis=1) * weight
            sums = np.zeros_like(c)
            np.add.at(sums, label, x * weight[:, None])
            held = np.bincount(label, weight, minlength=k)
            c = np.where(held[:, None] > 0, sums / np.maximum(held, 1e-300)[:, None], x[cost.argmax()])
        inertia = float((apart(c).min(axis=1) * weight).sum())
        if inertia < least:
            found, least = c + middle, inertia
    return found


def _nearest(rows: DataFrame, cols: Sequence[str], centres: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """``label`` of the nearest centre and ``_gap``, its squared distance; groups may
    have lists of different lengths."""
    values = centres.agg(F.sum(F.size("centres"))).first()[0] or 0
    if values * len(cols) <= SENT_VALUES:
        return _assign_in_batches(rows, cols, centres, group_cols, "_gap")
    held = centres.withColumnRenamed("centres", "_centres")
    held._rows = centres._rows
    joined = rows.join(small_side(held, SENT_VALUES // max(1, -(-values * len(cols) // max(1, held._rows)))), list(group_cols))
    labelled = joined.withColumns({"label": nearest_of_arrays(cols, "_centres"), "_gap": F.array_min(_gaps(cols, "_centres"))})
    return labelled.drop("_centres")


def nearest_centre(cols: Sequence[str], k: int) -> Column:
    """Label of the nearest of the centres in columns ``_c{i}_{axis}``, ties to
    the lowest label.

    Plain columns rather than an array keep the generated code small enough to
    be compiled; the value is never null, so a join on it adds no filter that
    would compute it again.
    """
    gaps = []
    for i in range(k):
        gaps.append(" + ".join(f"(`{c}` - _c{i}_{axis}) * (`{c}` - _c{i}_{axis})" for axis, c in enumerate(cols)))
    each = f"array({', '.join(gaps)})"  # a common subexpression, computed once
    return F.expr(f"coalesce(array_position({each}, array_min({each})) - 1, 0L)")


#: Beyond so many centre values a row, the code of plain columns would be too large to
#: compile: batches meet the centres in a matrix product, or, where the centres of all
#: groups are too many to be sent, centres stay arrays.  Labels are the same.
PLAIN_VALUES = 200


def nearest_of_arrays(cols: Sequence[str], centres: str = "centres") -> Column:
    """The same label from a column that holds the array of centres."""
    found = F.transform(F.array(_gaps(cols, centres)), lambda g: F.array_position(g, F.array_min(g)) - 1)[0]
    return F.coalesce(found, F.lit(0).cast("long"))


def _gaps(cols: Sequence[str], centres: str) -> Column:
    """Squared distances to an array of centres."""
    point = F.array(*[F.col(c).cast("double") for c in cols])
    squares = lambda c: F.zip_with(point, c, lambda a, b: (a - b) * (a - b))
    return F.transform(centres, lambda c: F.aggregate(squares(c), F.lit(0.0), lambda total, x: total + x))


#: Centre values of all groups together that may be sent to every task.
SENT_VALUES = 4_000_000


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The label of the nearest centre of each row of ``x``, ties to the lowest; 0
    for a row with a missing value.

    Distances come from one matrix product. Where others come as near as its
    rounding may be off, they are summed again axis by axis, which is exact in the sense of
    ``nearest_centre``.
    """
    size = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)
    gap = size - 2 * (x @ centres.T)
    least = gap.min(axis=1, keepdims=True)
    near = gap <= least + 1e-10 * size.max(axis=1, keepdims=True)
    label = gap.argmin(axis=1)
    close = np.flatnonzero(near.sum(axis=1) > 1)
    if len(close):
        total = np.zeros((len(close), len(centres)))
        for axis in range(x.shape[1]):
            total += (x[close, axis][:, None] - centres[:, axis]) ** 2
        label[close] = total.argmin(axis=1)
    label[~np.isfinite(size[:, 0])] = 0
    return label


def _assign_in_batches(
    df: DataFrame, cols: Sequence[str], centres: DataFrame, group_cols: Sequence[str], gap_col: str | None = None
) -> DataFrame:
    """``label`` by ``nearest_rows``, and in ``gap_col`` the squared distance to that
    centre; the centres are few enough to be sent."""
    group = list(group_cols)
    held = {tuple(r[g] for g in group): np.array(r["centres"], float) for r in centres.select(*group, "centres").collect()}
    sent = df.sparkSession.sparkContext.broadcast(held)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(sent.value)
        place = {k: i for i, k in enumerate(names)}
        for batch in batches:
            keys = zip(*(batch.column(g).to_pylist() for g in group)) if group else [()] * batch.num_rows
            of = np.fromiter((place.get(k, -1) for k in keys), np.int64, batch.num_rows)
            batch, of = batch.filter(pa.array(of >= 0)), of[of >= 0]  # as in a join, groups without centres go
            x = np.array([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in cols]).T
            label, gap = np.zeros(len(of), np.int64), np.zeros(len(of))
            for i in np.unique(of):
                here, c = of == i, sent.value[names[i]]
                label[here] = nearest_rows(x[here], c)
                if gap_col:
                    gap[here] = ((x[here] - c[label[here]]) ** 2).sum(axis=1)
            more = {"label": pa.array(label)} | ({gap_col: pa.array(gap)} if gap_col else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    return df.mapInArrow(step, f"{kinds}, label long" + (f", {gap_col} double" if gap_col else ""))


def assign(df: DataFrame, cols: Sequence[str], centres: DataFrame, k: int, group_cols: Sequence[str]) -> DataFrame:
    """Add ``label`` to every row; one small row of centres per group."""
    settled = settle(centres)
    if k * len(cols) > PLAIN_VALUES and settled._rows * k * len(cols) <= SENT_VALUES:
        return _assign_in_batches(df.drop("label"), cols, settled, group_cols)
    if k * len(cols) > PLAIN_VALUES:
        held = settled.select(*group_cols, F.col("centres").alias("_centres"))
        held._rows = settled._rows
        joined = df.join(small_side(held), list(group_cols))
        return joined.withColumn("label", nearest_of_arrays(cols, "_centres")).drop("_centres")
    names = [(i, axis) for i in range(k) for axis in range(len(cols))]
    flat = settled.select(*group_cols, *[F.expr(f"centres[{i}][{axis}]").alias(f"_c{i}_{axis}") for i, axis in names])
    flat._rows = settled._rows
    joined = df.join(small_side(flat), list(group_cols))
    return joined.withColumn("label", nearest_centre(cols, k)).drop(*[f"_c{i}_{axis}" for i, axis in names])


def sort_centres(centres: DataFrame) -> DataFrame:
    """Put centres in lexicographic order, so that labels are stable."""
    return centres.withColumn("centres", F.array_sort("centres"))


def lloyd(
    df: DataFrame, cols: Sequence[str], k: int, group_cols: Sequence[str], rounds: int, centres: DataFrame | None = None,
    tolerance: float | None = None,
) -> DataFrame:
    """``rounds`` full passes of Lloyd's algorithm; returns sorted centres.
    With ``tolerance`` they end once no centre of any group moves farther.

    Means are true means over all rows.  Each pass is one scan with map-side
    partial sums; only k rows per group are shuffled and kept, and lineage is
    cut after each pass.  A cluster left empty keeps its centre.
    """
    group = list(group_cols)
    if centres is None:
        centres = midpoint_centres(df, cols, k, group)
    centres = settle(centres)
    for _ in range(rounds):
        means = (
            assign(df, cols, centres, k, group)
            .groupBy(*group, "label")
            .agg(F.array(*[F.avg(c) for c in cols]).alias("_mean"))
            .groupBy(*group)
            .agg(F.map_from_entries(F.collect_list(F.struct("label", "_mean"))).alias("_means"))
        )
        moved = F.transform(
            "centres", lambda old, i: F.coalesce(F.try_element_at("_means", i.cast("long")), old)
        )
        after = means.join(small_side(centres), group).select(*group, moved.alias("centres"), F.col("centres").alias("_before"))
        if tolerance is None:
            centres = settle(after.drop("_before"))
            continue
        apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda total, x: total + x))
        shift = F.array_max(F.zip_with("centres", "_before", apart))
        kept = settle(after.select(*group, "centres", shift.alias("_shift")))
        centres = kept.drop("_shift")
        centres._rows = kept._rows
        if (kept.agg(F.max("_shift")).first()[0] or 0.0) <= tolerance:
            break
    return sort_centres(centres)


def spark_kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """K-means with k-means|| starts from Spark's own library, for one group of
    rows.  Returns a one-row table of sorted ``centres``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=list(cols), outputCol="_features").transform(df).select("_features")
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features").fit(vectors)
    found = sorted([float(x) for x in c] for c in model.clusterCenters())
    return df.sparkSession.createDataFrame([(found,)], "centres array<array<double>>")


def with_labels(
    df: DataFrame, cols: Sequence[str], k: int, group_cols: Sequence[str], rounds: int, centres: DataFrame | None = None
) -> DataFrame:
    """Cluster and label in one call.  ``rounds = 0`` uses the centres as given."""
    return assign(df, cols, lloyd(df, cols, k, group_cols, rounds, centres), k, group_cols)


__all__ = [
    "STARTING",
    "assign",
    "drawn_centres",
    "lloyd",
    "midpoint_centres",
    "midpoints_of",
    "nearest_centre",
    "nearest_of_arrays",
    "parallel_centres",
    "seeded_centres",
    "sort_centres",
    "spark_kmeans",
    "with_labels",
]
