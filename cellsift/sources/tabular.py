"""CSV snapshots, force logs and energy snapshots, all by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsift.functions.scalars import log_energy
from cellsift.operators.energy import COUNTERS
from cellsift.operators.rank import global_rank

# Columns of a cylinder snapshot and the roles they play.
CSV_COLUMNS = ("X", "Y", "dudx", "dudy", "dvdx", "dvdy", "vortZ", "TKE")
CSV_INPUTS = ("dudx", "dudy", "dvdx", "dvdy", "vortZ")
CSV_CLUSTER = "vortZ"
CSV_TIME = r"cylinder_t=?0*(\d+)"
ENERGY_NODE = r"([^/]+?)_snapshot_[^/]*$"


def read_csv_snapshots(spark: SparkSession, path: str, time_pattern: str = CSV_TIME) -> DataFrame:
    """Rows of every snapshot with ``timestep`` from the path, the inputs, the
    cluster variable, and ``log_tke`` as target."""
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in CSV_COLUMNS])
    files = spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true")
    rows = files.csv(path).withColumn("timestep", F.regexp_extract(F.input_file_name(), time_pattern, 1).cast("long"))
    return rows.withColumn("log_tke", log_energy(F.col("TKE"))).drop("TKE")


def parse_forces(lines: DataFrame, text: str = "value") -> DataFrame:
    """``time`` and ``drag`` (pressure part plus viscous part) of a force log.

    Brackets are separators; comment lines start with #.
    """
    clean = F.trim(F.regexp_replace(F.col(text), r"[()\s]+", " "))
    rows = lines.where(~F.trim(F.col(text)).startswith("#") & (F.trim(F.col(text)) != ""))
    parts = F.split(clean, " ")
    number = lambda i: F.element_at(parts, i + 1).cast("double")
    return rows.select(number(0).alias("time"), (number(1) + number(2)).alias("drag"))


def every_kth(forces: DataFrame, k: int = 100) -> DataFrame:
    """Every k-th record in time order, the first included."""
    return global_rank(forces, ["time"], (), "_rank").where(F.pmod(F.col("_rank"), F.lit(k)) == 0).drop("_rank")


def read_forces(spark: SparkSession, path: str, write_interval: int = 100) -> DataFrame:
    return every_kth(parse_forces(spark.read.text(path)), write_interval)


def read_energy_snapshots(spark: SparkSession, path: str, node_pattern: str = ENERGY_NODE, multi_line: bool = True) -> DataFrame:
    """Counter snapshots ``<node>_snapshot_<phase>.json`` with ``node_id`` from the
    file name; counters that could not be read are null."""
    schema = T.StructType(
        [
            T.StructField("timestamp", T.DoubleType()),
            T.StructField("timestamp_readable", T.StringType()),
            T.StructField("hostname", T.StringType()),
            T.StructField("phase", T.StringType()),
            *[T.StructField(c, T.DoubleType()) for c in (*COUNTERS, "Node")],
        ]
    )
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    if multi_line:
        reader = reader.option("multiLine", "true")
    return reader.json(path).withColumn("node_id", F.regexp_extract(F.input_file_name(), node_pattern, 1))
