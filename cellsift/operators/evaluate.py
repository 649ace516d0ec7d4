"""Comparison of samples and of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.session import small_side

# Fixed value: normalising constant of the Gaussian kernel, sqrt(2 pi).
ROOT_TWO_PI = 2.5066282746310002


#: Bins of the kernel density, in bandwidths, and how many moments each keeps. Within half a
#: bin the series of the kernel is then off by less than 1.4e-12 of the kernel's peak.
BIN_WIDTH, MOMENTS = 0.125, 8


def density_estimate(df: DataFrame, col: str, points: int, group_cols: Sequence[str]) -> DataFrame:
    """Gaussian kernel density on ``points`` evenly spaced values per group.

    Bandwidth n^(-1/5) times the sample deviation. One scan gives n, deviation and
    limits; a second adds each row's powers to its bin, a fixed cost per row
    however many points are asked for. Bins, not rows, then meet the points: the
    kernel around a bin's middle is a series in Hermite polynomials of the
    distance, with the bin's moments as weights. Each kernel value is
    exact to 1.4e-12, so a density to that over (bandwidth x sqrt(2 pi)).

    Missing values don't count. A group of one value, or of equal ones, has no
    bandwidth and a null density.
    """
    group = list(group_cols)
    stats = df.groupBy(*group).agg(
        F.count(col).alias("_n"), F.stddev_samp(col).alias("_s"), F.min(col).alias("_lo"), F.max(col).alias("_hi")
    )
    wide = F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_s")
    step = (F.col("_hi") - F.col("_lo")) / F.lit(points - 1)
    stats = small_side(
        stats.where("_n > 0").select(*group, "_n", F.when(F.col("_s") > 0, wide).alias("_h"), F.col("_lo").cast("double").alias("_lo"), step.cast("double").alias("_step"))
    )
    at = (F.col("_v") - F.col("_lo")) / F.col("_h")
    rows = df.select(*group, F.col(col).cast("double").alias("_v")).where("_v IS NOT NULL").join(stats.where("_h IS NOT NULL"), group)
    placed = rows.select(*group, (F.col("_step") / F.col("_h")).alias("_pitch"), at.alias("_at"), F.floor(at / F.lit(BIN_WIDTH)).alias("_bin"))
    middle = (F.col("_bin") + F.lit(0.5)) * F.lit(BIN_WIDTH)
    power, sums = F.lit(1.0), []
    for j in range(MOMENTS):
        sums.append(F.sum(power).alias(f"_m{j}"))
        power = power * (F.col("_off") / F.lit(float(j + 1)))  # of off, over the factorial
    binned = placed.withColumn("_off", F.col("_at") - middle).groupBy(*group, "_pitch", "_bin").agg(*sums)

    met = binned.withColumn("grid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    met = met.withColumn("_a", F.col("grid") * F.col("_pitch") - middle)
    # The sum of moments times Hermite polynomials, by the recurrence from the last.
    later, last = F.lit(0.0), F.lit(0.0)
    for j in reversed(range(MOMENTS)):
        later, last = last, F.col(f"_m{j}") + F.col("_a") * last - F.lit(float(j + 1)) * later
    added = met.groupBy(*group, "grid").agg(F.sum(F.exp(F.col("_a") * F.col("_a") * F.lit(-0.5)) * last).alias("_k"))
    grid = stats.withColumn("grid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    return grid.join(added, [*group, "grid"], "left").select(
        *group,
        "grid",
        (F.col("_lo") + F.col("_step") * F.col("grid")).alias("x_at"),
        (F.col("_k") / (F.col("_n") * F.col("_h") * F.lit(ROOT_TWO_PI))).alias("density"),
    )


def tagged(samples: dict[str, DataFrame], cols: Sequence[str], tag: str = "method") -> DataFrame:
    """Several row sets as one table with the name of each."""
    out = None
    for name, df in samples.items():
        one = df.select(*cols).withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def mean_squared_error(df: DataFrame, truth: str = "y", predicted: str = "yhat") -> DataFrame:
    return df.agg(F.avg((F.col(truth) - F.col(predicted)) * (F.col(truth) - F.col(predicted))).alias("mse"))


def absolute_errors(df: DataFrame, keys: Sequence[str], batch: int, truth: str = "y", predicted: str = "yhat") -> DataFrame:
    """Absolute error of every point, divided by the batch size."""
    return df.select(*keys, (F.abs(F.col(predicted) - F.col(truth)) / F.lit(float(batch))).alias("error"))


def parity_limits(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per output: smallest and largest value over truth and prediction."""
    wide = df.agg(
        *[
            f(g(t, p)).alias(f"{n}_{t}")
            for t, p in pairs
            for f, g, n in ((F.min, F.least, "lo"), (F.max, F.greatest, "hi"))
        ]
    )
    rows = [F.struct(F.lit(t).alias("output"), F.col(f"lo_{t}").alias("lo"), F.col(f"hi_{t}").alias("hi")) for t, _ in pairs]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
