"""Time windows: dense steps, tumbling reuse of a draw, sliding sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsift.functions.grid import int_div
from cellsift.params import TargetKind
from cellsift.session import small_side


def time_index(df: DataFrame, time_col: str = "timestep") -> DataFrame:
    """Distinct times with their dense index ``t_idx`` and their number ``n_t``.

    ``df`` may be the rows themselves or just a list of times, which saves a
    scan.  The window runs over the distinct times only, one row per timestep.
    """
    times = df.select(time_col).distinct()
    everything = Window.partitionBy(F.lit(0))
    return times.withColumns(
        {
            "t_idx": (F.dense_rank().over(everything.orderBy(time_col)) - 1).cast("long"),
            "n_t": F.count(F.lit(1)).over(everything),
        }
    )


def window_steps(times: DataFrame, window: int, time_col: str = "timestep") -> DataFrame:
    """Times with ``t_idx`` and ``window_id``; those after the last complete
    window are left out."""
    indexed = time_index(times, time_col)
    whole = indexed.where(F.col("t_idx") < int_div("n_t", window) * window)
    return whole.select(time_col, "t_idx", int_div("t_idx", window).alias("window_id"))


def with_windows(df: DataFrame, window: int, time_col: str = "timestep", times: DataFrame | None = None) -> DataFrame:
    """Add ``t_idx`` and ``window_id``; steps after the last complete window go."""
    return df.join(small_side(window_steps(df if times is None else times, window, time_col)), time_col)


def first_steps(windowed: DataFrame, window: int) -> DataFrame:
    """Rows of the first step of each window, where the draw is made."""
    return windowed.where(F.pmod(F.col("t_idx"), F.lit(window)) == 0)


def apply_selection(windowed: DataFrame, selection: DataFrame, id_cols: Sequence[str] = ("point_id",)) -> DataFrame:
    """A window's selection, applied to each of its steps."""
    keys = ["window_id", *id_cols]
    return windowed.join(small_side(selection), keys)


def project_target(windowed: DataFrame, sampled: DataFrame, target_cols: Sequence[str], kind: TargetKind, id_cols: Sequence[str] = ("point_id",)) -> DataFrame:
    """The target of a sample: one row per timestep, the sampled points, or all."""
    if kind is TargetKind.GLOBAL:
        firsts = [F.min(c).alias(c) for c in target_cols]
        return windowed.groupBy("timestep").agg(*firsts)
    source = windowed if kind is TargetKind.FULL else sampled
    return source.select("timestep", *id_cols, *target_cols)


def sequences(
    df: DataFrame,
    window: int,
    overlap: int,
    time_col: str = "timestep",
    entity_cols: Sequence[str] = ("cube_id",),
    times: DataFrame | None = None,
) -> DataFrame:
    """Sliding sequences over timesteps, per entity.

    Each row is copied to the sequences that cover its step: the starts are
    arithmetic on the dense time index, so no join of rows with starts is needed.
    Adds ``start`` (index of the sequence), ``step`` and ``seq_id``.
    """
    stride = window - overlap
    if stride <= 0:
        raise ValueError(f"window ({window}) must be larger than overlap ({overlap})")
    times = time_index(df if times is None else times, time_col)
    count = F.floor((F.col("n_t") - window) / F.lit(stride)) + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("t_idx") - window + 1) / F.lit(stride)))
    last = F.least(count - 1, F.floor(F.col("t_idx") / F.lit(stride)))
    covered = times.where((F.col("n_t") >= window) & (first <= last)).select(
        time_col, "t_idx", F.explode(F.sequence(first, last)).alias("start")
    )
    covered = covered.select(time_col, "start", (F.col("t_idx") - F.col("start") * stride).alias("step"))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in entity_cols], F.col("start").cast("string"))
    return df.join(small_side(covered), time_col).withColumn("seq_id", text)


def pack(df: DataFrame, seq_cols: Sequence[str], order_cols: Sequence[str], value_cols: Sequence[str], out: str = "values") -> DataFrame:
    """One array per sequence, ordered by step and slot.  A sequence holds
    window x samples rows, a size fixed by the parameters."""
    entries = F.array_sort(F.collect_list(F.struct(*order_cols, *value_cols)))
    return df.groupBy(*seq_cols).agg(entries.alias(out))


def channels_first(packed: DataFrame, value_cols: Sequence[str], out: str = "values") -> DataFrame:
    """Axis order for training: one array per channel instead of one of rows."""
    lists = [F.col(out)[c].alias(c) for c in value_cols]
    keep = [c for c in packed.columns if c != out]
    return packed.select(*keep, *lists)


def ordered_split(df: DataFrame, seq_cols: Sequence[str], test_frac: float, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Tag rows ``train`` or ``test`` by sequence.

    The last ceil(f n) sequences in order are the test part; with ``shuffle`` the
    order is a seeded key.  Ranks are taken over the table of sequences.
    """
    from cellsift.functions.keys import uniform_key
    from cellsift.operators.rank import global_rank

    seqs = df.select(*seq_cols).distinct()
    order = [*seq_cols]
    if shuffle:
        seqs = seqs.withColumn("_order", uniform_key(list(seq_cols), f"split-{seed}"))
        order = ["_order", *order]
    ranked = global_rank(seqs, order, (), "_rank", size="_total")
    cut = F.col("_total") - F.ceil(F.col("_total") * F.lit(test_frac))
    parts = ranked.select(*seq_cols, F.when(F.col("_rank") >= cut, "test").otherwise("train").alias("split"))
    return df.join(small_side(parts), list(seq_cols))


def complete_timesteps(df: DataFrame, variables: Sequence[str], time_col: str = "timestep", var_col: str = "variable") -> DataFrame:
    """Rows of the timesteps that have every one of ``variables``."""
    wanted = df.where(F.col(var_col).isin(list(variables)))
    whole = wanted.groupBy(time_col).agg(F.count_distinct(var_col).alias("_n")).where(F.col("_n") == len(variables))
    return wanted.join(small_side(whole.select(time_col)), time_col, "left_semi")


def incomplete_timesteps(df: DataFrame, variables: Sequence[str], time_col: str = "timestep", var_col: str = "variable") -> DataFrame:
    """Timesteps that miss a variable, with the number present."""
    return missing_variables(df, variables, time_col, var_col).drop("missing")


def missing_variables(df: DataFrame, variables: Sequence[str], time_col: str = "timestep", var_col: str = "variable") -> DataFrame:
    """The report of incomplete timesteps: how many variables are present, and the
    names of the missing ones in order."""
    wanted = F.array(*[F.lit(v) for v in sorted(variables)])
    present = F.collect_set(F.when(F.col(var_col).isin(list(variables)), F.col(var_col)))
    found = df.groupBy(time_col).agg(present.alias("_present")).where(F.size("_present") < len(variables))
    return found.select(time_col, F.size("_present").cast("long").alias("n_present"), F.array_except(wanted, "_present").alias("missing"))


def match_times(requested: DataFrame, available: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Requested times with the available time they match, null for a miss.

    Times are cut into cells of the tolerance and joined on the cell and its two
    neighbours, an equi join in place of a band join over all pairs.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    near = requested.select("requested").distinct().withColumn("_cell", F.explode(F.array(*[cell("requested") + i for i in (-1, 0, 1)])))
    have = available.select(F.col("timestep").alias("_ts")).distinct().withColumn("_cell", cell("_ts"))
    hits = near.join(have, "_cell").where(F.abs(F.col("_ts") - F.col("requested")) < tolerance)
    best = hits.groupBy("requested").agg(F.min("_ts").alias("timestep"))
    return requested.select("requested").distinct().join(best, "requested", "left")


def rows_at_times(df: DataFrame, matched: DataFrame, time_col: str = "timestep") -> DataFrame:
    """Rows at the matched times."""
    keep = matched.where(F.col("timestep").isNotNull()).select(F.col("timestep").alias(time_col)).distinct()
    return df.join(small_side(keep), time_col, "left_semi")


