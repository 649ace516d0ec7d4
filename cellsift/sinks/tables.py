"""Writers of curated data.  All are partitioned Spark writes: tasks write their
own files and a commit makes them visible, so a retried task leaves no trace."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.windows import complete_timesteps, missing_variables
from cellsift.session import settle


#: Bytes of a file, as the rows take in memory.
FILE_BYTES = 256 * 1024 * 1024
# Bytes of the types that a field has; others count as WIDE_BYTES.
TYPE_BYTES = {"double": 8, "bigint": 8, "float": 4, "int": 4, "smallint": 2, "tinyint": 1, "boolean": 1}
WIDE_BYTES = 32


def laid_out(df: DataFrame, file_bytes: int = FILE_BYTES, time_col: str = "timestep") -> DataFrame:
    """``df`` dealt out so that a partitioned write makes files of about
    ``file_bytes``, one at least for each timestep.

    The rows of each timestep are counted; a timestep with many is dealt out by a hash
    of its rows, a task for each file, so that neither tasks times
    timesteps files come out nor a large timestep goes through one task.
    """
    width = sum(TYPE_BYTES.get(f.dataType.simpleString(), WIDE_BYTES) for f in df.schema.fields)
    counts = settle(df.groupBy(time_col).agg(F.count(F.lit(1)).alias("_n")))
    sized = counts.select(F.col(time_col).alias("_time"), F.ceil(F.col("_n") * F.lit(float(width)) / F.lit(float(file_bytes))).alias("_files"))
    if counts._rows > PLANNED_TIMES:
        return df.repartition(time_col)
    rows = sorted(sized.collect(), key=lambda r: (r["_time"] is not None, r["_time"]))  # a row for each timestep
    first, plan = 0, []
    for r in rows:
        plan.append((r["_time"], r["_files"], first))
        first += r["_files"]
    if not plan:
        return df
    places = df.sparkSession.createDataFrame(plan, sized.schema.add("_first", "long"))
    lane = F.col("_first") + F.pmod(F.xxhash64(*df.columns), F.col("_files"))
    dealt = df.join(F.broadcast(places), F.col(time_col).eqNullSafe(F.col("_time"))).withColumn("_lane", lane.cast("int"))
    return dealt.repartitionById(first, "_lane").select(*df.columns)


#: Up to so many timesteps the files are planned one by one; beyond, a timestep is a task.
PLANNED_TIMES = 100_000


def write_curated(df: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Inputs, targets and coordinates, one folder per timestep."""
    laid_out(df, file_bytes).write.partitionBy("timestep").parquet(path)


def write_selection(selection: DataFrame, path: str) -> None:
    """The chosen points of every window."""
    selection.write.partitionBy("window_id").parquet(path)


def write_boxes(chosen: DataFrame, path: str) -> None:
    """The chosen boxes of every timestep, from one writer."""
    chosen.select("timestep", "ix", "iy", "iz").write.parquet(path)


def write_csv(df: DataFrame, path: str, output_vars: Sequence[str], input_vars: Sequence[str]) -> None:
    """CSV per timestep: targets first, then inputs."""
    laid_out(df.select("timestep", *output_vars, *input_vars)).write.partitionBy("timestep").option("header", "true").csv(path)


def write_complete_samples(long: DataFrame, path: str, variables: Sequence[str]) -> DataFrame:
    """Samples of the timesteps that have every variable. Returned is the report of
    the others: ``timestep, n_present, missing``."""
    complete_timesteps(long, variables).write.partitionBy("timestep").parquet(path)
    return settle(missing_variables(long, variables))


def first_timestep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Features of the earliest timestep.  The time is looked up first, so the
    scan that follows reads one timestep only."""
    earliest = df.agg(F.min("timestep")).first()[0]
    return df.where(F.col("timestep") == earliest).select(*cols)


def write_first_timestep(df: DataFrame, path: str, cols: Sequence[str]) -> None:
    first_timestep(df, cols).write.parquet(path)


def write_downsampled(df: DataFrame, path: str, n: int) -> None:
    """A down-sampled set, in a folder named by its size; a rerun replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/n_samples={n}")
