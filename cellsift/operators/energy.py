"""Energy use from counter snapshots of the nodes of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.rank import global_rank

# Counters of a snapshot, and the two groups they form.
CPU_COUNTERS = ("CPU", "Mem")
GPU_COUNTERS = ("Accel0", "Accel1", "Accel2", "Accel3")
COUNTERS = CPU_COUNTERS + GPU_COUNTERS


def _sum(cols):
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def _watts(joules, seconds):
    return F.when(seconds > 0, joules / seconds)


def intervals(snapshots: DataFrame) -> DataFrame:
    """Joules per counter between consecutive snapshots of a node, their total
    over the counters that were read, and the average power.

    Each snapshot meets its predecessor by rank, an equi join that spreads over
    tasks however many snapshots one node has.
    """
    columns = ["node_id", "timestamp", "phase", *COUNTERS]
    ranked = global_rank(snapshots.select(*columns), ["timestamp", "phase"], ["node_id"], "_rank")
    before = ranked.select(
        "node_id",
        (F.col("_rank") + 1).alias("_rank"),
        F.col("timestamp").alias("_then"),
        F.col("phase").alias("from_phase"),
        *[F.col(c).alias(f"_{c}") for c in COUNTERS],
    )
    deltas = {f"d_{c}": F.col(c) - F.col(f"_{c}") for c in COUNTERS}
    steps = ranked.join(before, ["node_id", "_rank"]).withColumns({"elapsed": F.col("timestamp") - F.col("_then"), **deltas})
    joules = _sum([F.coalesce(f"d_{c}", F.lit(0.0)) for c in COUNTERS])
    return steps.select(
        "node_id", "from_phase", F.col("phase").alias("to_phase"), "elapsed", *deltas, joules.alias("joules"),
        _watts(joules, F.col("elapsed")).alias("watts"),
    )


def node_energy(snapshots: DataFrame) -> DataFrame:
    """Energy of each node from its first to its last snapshot."""
    ends = snapshots.groupBy("node_id").agg(
        F.min("timestamp").alias("started"),
        F.max("timestamp").alias("ended"),
        *[F.max_by(c, F.struct("timestamp", "phase")).alias(f"last_{c}") for c in COUNTERS],
        *[F.min_by(c, F.struct("timestamp", "phase")).alias(f"first_{c}") for c in COUNTERS],
    )
    # A counter that a node lacks, at either end, adds nothing, as in ``intervals``.
    used = lambda names: _sum([F.coalesce(F.col(f"last_{c}") - F.col(f"first_{c}"), F.lit(0.0)) for c in names])
    elapsed = F.col("ended") - F.col("started")
    return ends.select(
        "node_id",
        "started",
        "ended",
        used(CPU_COUNTERS).alias("cpu_joules"),
        used(GPU_COUNTERS).alias("gpu_joules"),
        elapsed.alias("elapsed"),
    ).withColumns(
        {
            "joules": F.col("cpu_joules") + F.col("gpu_joules"),
            "watts": _watts(F.col("cpu_joules") + F.col("gpu_joules"), F.col("elapsed")),
        }
    )


def job_energy(nodes: DataFrame) -> DataFrame:
    """Energy of all nodes together; time runs from the first start to the last end."""
    total = nodes.agg(
        F.sum("joules").alias("joules"),
        F.sum("cpu_joules").alias("cpu_joules"),
        F.sum("gpu_joules").alias("gpu_joules"),
        (F.max("ended") - F.min("started")).alias("elapsed"),
    )
    return total.withColumn("watts", _watts(F.col("joules"), F.col("elapsed")))
