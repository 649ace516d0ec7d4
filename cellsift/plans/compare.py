"""Sampling methods side by side: the distribution of one column in each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.evaluate import density_estimate, tagged
from cellsift.operators.histogram import density_histogram
from cellsift.operators.samplers import SAMPLERS
from cellsift.session import written

# Fixed value: methods that are compared.
COMPARED = ("full", "random", "uips", "maxent")


def sample_each(df: DataFrame, n: int, col: str, methods: Sequence[str] = COMPARED, id_col: str = "point_id", **options) -> DataFrame:
    """Samples of every method in one tagged table, written down once."""
    samples = {m: SAMPLERS[m](df, n, id_col=id_col, cluster_cols=[col], **options) for m in methods}
    return written(tagged(samples, ["timestep", id_col, col]), "compared")


def compare_methods(df: DataFrame, n: int, col: str, edges: int, timestep=None, **options) -> tuple[DataFrame, DataFrame]:
    """Density histogram and kernel density of ``col`` per method."""
    if timestep is not None:
        df = df.where(F.col("timestep") == timestep)
    samples = sample_each(df, n, col, **options)
    keys = ["timestep", "method"]
    return density_histogram(samples, col, edges, keys), density_estimate(samples, col, edges, keys)
