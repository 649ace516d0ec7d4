"""One entry point for all formats: a name, a path, the parameters."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.operators.windows import match_times, rows_at_times
from cellsift.params import VECTORS, CurationParams
from cellsift.sources.arrays import npz_snapshots
from cellsift.sources.openfoam import read_snapshots
from cellsift.sources.rawgrid import grid_times, read_raw_grid
from cellsift.sources.tabular import read_csv_snapshots


#: The raw formats and how their files lie.
LAYOUTS = {"raw-grid": "flat", "cube-dirs": "var_dir", "cube-blocks": "block_dir"}


def _raw(format_name: str, spark: SparkSession, path: str, p: CurationParams) -> DataFrame:
    """Strides and offsets hold for every layout; the padding lies at the end of
    a whole x axis, so a block of one has none."""
    layout = LAYOUTS[format_name]
    options = {"skips": (p.nxskip, p.nyskip, p.nzskip), "offsets": (p.nxoffset, p.nyoffset, p.nzoffset)}
    if layout == "block_dir":
        options["sizes"] = p.box
        options["cubes"] = p.cubes_per_file
    else:
        options["pad"] = p.pad
    if layout != "flat":
        options["vectors"] = [v for v in p.variables if v in VECTORS]
    df = read_raw_grid(spark, path, p.variables, p.grid, layout=layout, **options)
    if p.timesteps is None:
        return df
    # Times come from file names, and the filter reaches the reader: no other file is opened.
    have = grid_times(spark, path, p.variables, p.grid, layout=layout, cubes=p.cubes_per_file)
    requested = spark.createDataFrame([(float(t),) for t in p.timesteps], "requested double")
    hits = match_times(requested, have).where("timestep IS NOT NULL").select("timestep").distinct().collect()
    return df.where(F.col("timestep").isin([r["timestep"] for r in hits]))


def _csv(spark: SparkSession, path: str, p: CurationParams) -> DataFrame:
    """Files 1 to ``num_timesteps``: snapshots are numbered one by one, whatever
    interval of simulated time (``write_interval``) lies between them."""
    return read_csv_snapshots(spark, path).where(F.col("timestep").between(1, p.num_timesteps))


LOADERS = {
    **{name: partial(_raw, name) for name in LAYOUTS},
    "csv": _csv,
    "npz": lambda spark, path, p: npz_snapshots(spark, path, p.variables),
    "openfoam": lambda spark, path, p: read_snapshots(spark, path, p.write_interval, p.num_timesteps),
}


def load(spark: SparkSession, format_name: str, path: str, params: CurationParams) -> DataFrame:
    """Read ``path``; of the requested timesteps those that exist, matched with
    a tolerance of one millionth."""
    df = LOADERS[format_name](spark, path, params)
    if params.timesteps is None or format_name in LAYOUTS:
        return df
    requested = spark.createDataFrame([(float(t),) for t in params.timesteps], "requested double")
    return rows_at_times(df, match_times(requested, df.select("timestep").distinct()))
