"""What is on disk: times in file names, and file sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.functions.scalars import TIME_IN_RAW_NAME, time_from_name


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of every file; contents are pruned, so none is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "length")


def available_times(paths: DataFrame, pattern: str = TIME_IN_RAW_NAME, path_col: str = "path") -> DataFrame:
    """Distinct times found in names, in order; other names are skipped."""
    times = paths.select(time_from_name(F.col(path_col), pattern).alias("timestep"))
    return times.where(F.col("timestep").isNotNull()).distinct().orderBy("timestep")


def sizes_checked(paths: DataFrame, cells: int | Column, value_bytes: int = 4, channels: int = 1, fail: bool = True) -> DataFrame:
    """Files with their number of values and whether it is the expected one.

    With ``fail`` a wrong size stops the job when the row is read.
    """
    expected = (F.lit(cells) if isinstance(cells, int) else cells) * F.lit(channels)
    counted = F.floor(F.col("length") / F.lit(value_bytes)).cast("long")
    out = paths.withColumns({"counted": counted, "expected": expected.cast("long")})
    if fail:
        message = F.format_string("%s holds %d values where %d are expected", F.col("path"), F.col("counted"), F.col("expected"))
        bad = F.when(F.col("counted") != F.col("expected"), F.raise_error(message).cast("long"))
        return out.withColumn("counted", F.coalesce(bad, F.col("counted")))
    return out.withColumn("ok", (F.col("counted") == F.col("expected")).cast("int"))
