"""Profiles of a table: ranges, sparsity, sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of a value of each type.
WIDTHS = {
    T.DoubleType: 8,
    T.FloatType: 4,
    T.LongType: 8,
    T.IntegerType: 4,
    T.ShortType: 2,
    T.ByteType: 1,
    T.BooleanType: 1,
}


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: smallest, mean, largest.  One scan for all columns."""
    wide = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.avg, "mid"), (F.max, "hi"))])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("lo"), F.col(f"mid_{c}").alias("mean"), F.col(f"hi_{c}").alias("hi"))
        for c in cols
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sparsity(df: DataFrame, cols: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Share of values of all ``cols`` that are zero within a tolerance."""
    tiny = None
    for c in cols:
        one = F.when(F.abs(F.col(c)) > tolerance, 0).otherwise(1)
        tiny = one if tiny is None else tiny + one
    return df.agg((F.sum(tiny) / (F.count(F.lit(1)) * len(cols))).alias("sparsity"))


def padded_limits(df: DataFrame, cols: Sequence[str], share: float = 0.05) -> DataFrame:
    """Limits of each column, widened by a share of its range."""
    stats = column_stats(df, cols)
    pad = (F.col("hi") - F.col("lo")) * F.lit(share)
    return stats.select("column", (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def dataset_profile(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], heads: int = 3) -> DataFrame:
    """Per column: type, number of values, bytes, and the first values by id.

    The first values come from one bounded top-k per column over the scan.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    count = F.lit(df.count()).cast("long")
    order = df.select(*id_cols, *cols).orderBy(*id_cols).limit(heads)
    first = order.agg(
        *[
            F.transform(F.array_sort(F.collect_list(F.struct(*id_cols, F.col(c).cast("double").alias("v")))), lambda s: s["v"]).alias(c)
            for c in cols
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(types[c].simpleString()).alias("type"),
                count.alias("n"),
                (count * F.lit(WIDTHS[type(types[c])])).alias("bytes"),
                F.col(c).alias("head"),
            )
            for c in cols
        ]
    )
    return first.select(F.explode(rows).alias("r")).select("r.*")
