"""Session set-up, the shared scratch folder, and size-checked small tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only after it has been counted and found to be within
#: this many rows; beyond it the same join runs as a shuffle join, where AQE
#: splits skewed partitions.
BROADCAST_ROWS = 100_000


def build_session(
    cores: int | str = "*", app: str = "cellsift", shuffle_partitions: int = 8, scratch: str | None = None
) -> SparkSession:
    """A local session with the settings the library is tested with.

    ``scratch`` is the folder of checkpoints and written intermediates.
    """
    builder = SparkSession.builder if scratch is None else SparkSession.builder.config("spark.checkpoint.dir", scratch)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each context.

    Workers then need no installed copy, whatever folder the job starts in.
    """
    context = spark.sparkContext
    if getattr(context, "_cellsift_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="cellsift-package-")  # the driver serves the file from here
    archive = os.path.join(folder, "cellsift-package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._cellsift_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, laptops) a
    folder is made here.  Elsewhere executors wouldn't see it, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if named is None and current is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cellsift-")
    if current is None:
        context.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path for one written table; never used twice."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a small table once and cut its lineage: written as Parquet to the
    shared folder. (A reliable checkpoint would compute it twice.)

    The rows are counted on the way; a table that is settled already stays.
    """
    if isinstance(getattr(df, "_rows", None), int):  # not a column of that name
        return df
    seen = Observation()
    kept = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), "settled")
    kept._rows = seen.get["rows"]
    return kept


def written(df: DataFrame, label: str) -> DataFrame:
    """Compute a large table once: written as Parquet to the shared folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Settle ``df`` and hint a broadcast only if it is within ``max_rows``."""
    df = settle(df)
    return F.broadcast(df) if df._rows <= (BROADCAST_ROWS if max_rows is None else max_rows) else df
