"""From a curated table to a training table: sequences, split, scale, pack."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsift.operators.scaling import FittedScaler, fit, fit_together
from cellsift.operators.windows import channels_first, ordered_split, pack, sequences
from cellsift.params import CurationParams, TargetKind
from cellsift.plans.curate import Curated
from cellsift.session import settle, small_side


@dataclass
class TrainingTable:
    """Scaled rows, the packed table, and the scalers fitted on the train part."""

    rows: DataFrame
    packed: DataFrame
    x_scaler: FittedScaler
    y_scaler: FittedScaler


def training_table(
    df: DataFrame,
    input_vars: Sequence[str],
    output_vars: Sequence[str],
    window: int,
    overlap: int,
    test_frac: float,
    xscaler: str = "MinMaxScaler",
    yscaler: str = "StandardScaler",
    entity_cols: Sequence[str] = ("cube_id",),
    slot_col: str = "point_id",
    times: DataFrame | None = None,
    shuffle: bool = False,
    seed: int = 0,
) -> TrainingTable:
    """Sequences of each entity, split by sequence, scaled per channel with
    constants of the train part, packed to one row per sequence with an array
    per channel."""
    seq_cols = [*entity_cols, "start"]
    rows = sequences(df, window, overlap, entity_cols=entity_cols, times=times)
    rows = ordered_split(rows, seq_cols, test_frac, shuffle, seed)
    train = rows.where(F.col("split") == "train")
    x_scaler, y_scaler = fit_together(train, [(xscaler, input_vars), (yscaler, output_vars)])
    scaled = y_scaler.transform(x_scaler.transform(rows))
    values = list(dict.fromkeys([*input_vars, *output_vars]))
    packed = channels_first(pack(scaled, ["split", "seq_id"], ["step", slot_col], values), values)
    return TrainingTable(scaled, packed, x_scaler, y_scaler)


@dataclass
class TrainingJob:
    """Scaled rows of inputs and targets by sequence, both packed, and the scalers."""

    inputs: DataFrame
    targets: DataFrame
    packed: DataFrame
    x_scaler: FittedScaler
    y_scaler: FittedScaler


def training_job(curated: Curated, params: CurationParams) -> TrainingJob:
    """The training table of a curation, all settings from its parameters.

    Sequences are those of the inputs, per box. Targets follow them whatever their
    kind: the same points, all points of the box, or one row per timestep, which every
    box's sequences share. ``packed`` has a row per sequence with an array per
    input, and ``target_`` arrays of the outputs in their own order of steps and
    points. Both scalers see the train part only.
    """
    steps, slot = (params.window, params.overlap), ["point_id"]
    times = settle(curated.inputs.select("timestep").distinct())
    x = ordered_split(sequences(curated.inputs, *steps, times=times), ["cube_id", "start"], params.test_frac, params.shuffle, params.seed)
    parts = settle(x.select("cube_id", "start", "seq_id", "split").distinct())
    shared = params.target_kind is TargetKind.GLOBAL
    entity = [] if shared else ["cube_id"]
    y = sequences(curated.targets, *steps, entity_cols=entity, times=times).drop("seq_id")
    y = y.join(small_side(parts), [*entity, "start"])

    train = F.col("split") == "train"
    x_scaler = fit(params.xscaler, x.where(train), params.input_vars)
    y_scaler = fit(params.yscaler, y.where(train), params.output_vars)
    x, y = x_scaler.transform(x), y_scaler.transform(y)
    packed = []
    for rows, names, order in ((x, params.input_vars, slot), (y, params.output_vars, [] if shared else slot)):
        packed.append(channels_first(pack(rows, ["split", "seq_id"], ["step", *order], list(names)), list(names)))
    outputs = packed[1].withColumnsRenamed({c: f"target_{c}" for c in params.output_vars})
    return TrainingJob(x, y, packed[0].join(outputs, ["split", "seq_id"]), x_scaler, y_scaler)
