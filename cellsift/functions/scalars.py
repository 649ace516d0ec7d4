"""Scalar functions of single values and of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Floor of the energy logarithm, and the name formats.
TKE_TINY = 1e-9
TKE_FLOOR = 1e-8
NAME_FORMAT = "%s_%.6f"
TIME_IN_RAW_NAME = r"_([0-9]+\.[0-9]+)$"
TIME_IN_NPZ_NAME = r"_t(\d+\.\d+)\.npz"
TIME_IN_CUBE_NAME = r"\.(\d+)$"


def log_energy(value: Column) -> Column:
    """Logarithm of the magnitude, with tiny values lifted to a floor."""
    size = F.abs(value)
    return F.log(F.when(size <= TKE_TINY, F.lit(TKE_FLOOR)).otherwise(size))


def norm(components: Sequence[Column]) -> Column:
    """Euclidean length."""
    total = components[0] * components[0]
    for c in components[1:]:
        total = total + c * c
    return F.sqrt(total)


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    gap = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x))


def rescale(df: DataFrame, col: str, out: str, group_cols: Sequence[str], a: float = 0.01, b: float = 0.99) -> DataFrame:
    """Stretch ``col`` linearly onto [a, b] within each group.

    The limits are aggregated first, so no group is gathered in one task.
    """
    from cellsift.session import small_side

    limits = df.groupBy(*group_cols).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    joined = df.join(small_side(limits), list(group_cols))
    scaled = (F.col(col) - F.col("_lo")) * F.lit(b - a) / (F.col("_hi") - F.col("_lo")) + F.lit(a)
    return joined.withColumn(out, scaled).drop("_lo", "_hi")


def time_from_name(name: Column, pattern: str = TIME_IN_RAW_NAME) -> Column:
    """Time in a file name; null where the name does not match."""
    text = F.regexp_extract(name, pattern, 1)
    return F.when(text != "", text.cast("double"))


def name_from_time(variable: Column, time: Column) -> Column:
    return F.format_string(NAME_FORMAT, variable, time)


def near_zero_filter(df: DataFrame, col: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose value is not (nearly) zero."""
    return df.where(F.abs(F.col(col)) > tolerance)


def latin_design(spark, groups: DataFrame, n: int, axes: int, group_cols: Sequence[str], seed: int = 0) -> DataFrame:
    """Latin hypercube of ``n`` points per group in the unit cube.

    Every axis is cut into ``n`` intervals; each interval is used once.  The
    permutation is the rank of a seeded key, the place inside the interval
    another seeded key.  Output: group columns, ``design_id``, ``d0 .. d{axes-1}``.
    """
    from cellsift.functions.keys import uniform_key

    rows = groups.select(*group_cols).distinct().withColumn("design_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    rows = rows.withColumn("_axis", F.explode(F.sequence(F.lit(0), F.lit(axes - 1))))
    key = [*group_cols, "design_id"]
    named = lambda what: F.concat(F.lit(what), F.col("_axis").cast("string"), F.lit(f"-{seed}"))
    order = Window.partitionBy(*group_cols, "_axis").orderBy(uniform_key(key, named("perm")), "design_id")
    at = (F.row_number().over(order) - 1 + uniform_key(key, named("place"))) / F.lit(float(n))
    each = rows.withColumn("_at", at).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_axis", "_at"))).alias("_d"))
    return each.select(*key, *[F.col("_d")[i]["_at"].alias(f"d{i}") for i in range(axes)])
