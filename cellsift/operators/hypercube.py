"""Latin hypercube sampling: for each point of a design, in order, the nearest
row that is still free.

Rows are laid into the cells of a grid and written down once, in the order of the cells.
A cell's bounding box tells how near and how far its rows are at least and at
most, so a design point looks only into cells that can hold one of its next
nearest rows. The choice is a deferred acceptance: blocks of design points choose side by
side, a row stays with the lowest design number that asks for it, and blocks choose again
while others' claims on their rows change. Only design points whose list has run
out look for further rows, in the cells that can hold these.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsift.functions.bins import bin_index
from cellsift.functions.scalars import latin_design
from cellsift.session import settle, small_side, written

#: Rows of a cell that a task holds at once; fewer where rows have many values.
CHUNK_ROWS = 500_000
CHUNK_VALUES = 4_000_000
#: Rows that a cell has on average, and cells of a group at most.
CELL_ROWS = 20_000
MOST_CELLS = 4096
#: In more dimensions boxes exclude next to nothing, and a group is one cell.
MOST_AXES = 6
#: Nearest rows of a design point at first; lists that run out are doubled.
KEEP = 16
#: Design points that choose in one task.
BLOCK = 2500
#: After so many rounds without agreement, blocks are joined in pairs.
PATIENCE = 8
#: Distances held at once inside a task.
BLOCK_VALUES = 2_000_000
#: So few cells are read by name, which skips the rest of the written table.
NAMED_CELLS = 1000


def _cell(size: Column, d: int) -> Column:
    """The number of a row's cell: its bins along each axis, over the range of its group."""
    if d > MOST_AXES:
        return F.when(size > 0, F.lit(0)).cast("long")
    most = int(MOST_CELLS ** (1 / d) + 1e-9)
    bins = F.least(F.lit(most), F.ceil(F.pow(size / F.lit(float(CELL_ROWS)), F.lit(1.0 / d)))).cast("long")
    at = F.lit(0).cast("long")
    for i in range(d):
        at = at * F.lit(most) + bin_index(F.col("_x")[i], F.col(f"lo{i}"), F.col(f"hi{i}"), bins)
    return at


def _nearest(ids: np.ndarray, x: np.ndarray, targets: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each target the ``keep`` nearest of ``x``, ties to the lowest id, with their
    distances. ``ids`` ascend."""
    m = min(keep, len(ids))
    found = []
    for at in range(0, len(targets), max(1, BLOCK_VALUES // len(ids))):
        some = targets[at : at + max(1, BLOCK_VALUES // len(ids))]
        square = np.zeros((len(some), len(ids)))
        for axis in range(x.shape[1]):
            square += (x[:, axis][None, :] - some[:, axis][:, None]) ** 2
        dist = np.sqrt(square)
        edge = np.partition(dist, m - 1, axis=1)[:, m - 1]
        for gaps, far in zip(dist, edge):
            near = np.flatnonzero(gaps <= far)
            near = near[np.argsort(gaps[near], kind="stable")][:m]
            found.append((ids[near], gaps[near]))
    return found


def _visits(low: np.ndarray, high: np.ndarray, rows: np.ndarray, targets: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of target and cell such that a target's cells hold its ``keep`` nearest rows for certain."""
    of, cells = [], []
    for at in range(0, len(targets), 256):
        t = targets[at : at + 256]
        near, far = np.zeros((2, len(t), len(low)))
        for axis in range(t.shape[1]):
            below, above = low[:, axis][None, :] - t[:, axis][:, None], t[:, axis][:, None] - high[:, axis][None, :]
            near += np.maximum(np.maximum(below, above), 0) ** 2
            far += np.maximum(np.abs(below), np.abs(above)) ** 2
        order = np.argsort(far, axis=1)
        enough = (np.cumsum(rows[order], axis=1) >= keep).argmax(axis=1)
        reach = far[np.arange(len(t)), order[np.arange(len(t)), enough]]
        a, b = np.nonzero(near <= reach[:, None] * (1 + 1e-9))
        of.append(a + at)
        cells.append(b)
    return np.concatenate(of), np.concatenate(cells)


def _choose(design: np.ndarray, lists: list, outside: dict) -> list:
    """The row that each design point claims: its nearest that no lower one of the
    block claims, and no lower one outside of it holds. None: its list has run out."""
    claimed, picks = set(), [None] * len(design)
    for i in np.argsort(design):
        for row in lists[i]:
            if row not in claimed and outside.get(row, design[i]) >= design[i]:
                claimed.add(row)
                picks[i] = row
                break
    return picks


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns as new ones, for a cogroup with a table that ``df`` is made from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def latin_hypercube(
    df: DataFrame,
    n: int,
    *,
    feature_cols: Sequence[str],
    id_col: str = "point_id",
    group_cols: Sequence[str] = ("timestep",),
    seed: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    keep: int | None = None,
    block: int = BLOCK,
    **_,
) -> DataFrame:
    """Rows of ``df`` with the ``design_id`` that took them, ``n`` of each group.

    A group's design covers the range of its features. Equal distances go to the
    lowest id. Rows with a missing feature are no candidates; a group of
    fewer than ``n`` others raises. ``df`` is read three times: for
    the ranges, to lay out the cells, and to fetch the rows that were picked.
    """
    if not group_cols:
        raise ValueError("a Latin hypercube needs a group column; a constant one makes all rows a group")
    group, d = list(group_cols), len(feature_cols)
    ds = [f"d{i}" for i in range(d)]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    typed = lambda *names: ", ".join(f"`{g}` {kinds[g]}" for g in names)
    whole = lambda x: x.isNotNull() & ~F.isnan(x)
    plain = df.select(*group, F.col(id_col).alias("_id"), F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("_x")).filter(F.forall("_x", whole))
    limits = settle(plain.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"), *[f(F.col("_x")[i]).alias(f"{p}{i}") for i in range(d) for f, p in ((F.min, "lo"), (F.max, "hi"))]))
    short = F.raise_error(F.format_string("%d design points were asked of a group of %d rows", F.lit(n), F.col("_size"))).cast("long")
    size = F.when(F.col("_size") < n, short).otherwise(F.col("_size"))

    spans = [f"{p}{i}" for i in range(d) for p in ("lo", "hi")] if d <= MOST_AXES else []
    cells = plain.join(small_side(limits).select(*group, "_size", *spans), group).select(*group, "_id", "_x", _cell(size, d).alias("_cell"), F.xxhash64(F.lit(seed), "_id").alias("_salt"))
    order = [*group, "_cell", "_salt"]
    points = written(cells.repartitionByRange(*order).sortWithinPartitions(*order), "hypercube-cells")
    most = max(1, min(chunk_rows, CHUNK_VALUES // d))
    if d <= MOST_AXES:
        ends = [F.array(*[f(F.col("_x")[i]) for i in range(d)]).alias(name) for f, name in ((F.min, "_low"), (F.max, "_high"))]
        boxes = points.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_held"), *ends)
    else:
        boxes = limits.select(*group, F.lit(0).cast("long").alias("_cell"), size.alias("_held"))
    boxes = settle(boxes.withColumn("_slices", F.ceil(F.col("_held") / F.lit(most))))

    blocks = max(1, -(-n // block))
    unit = latin_design(df.sparkSession, limits, n, d, group, seed)
    scaled = [(F.col(f"lo{i}") + F.col(x) * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(f"_t{i}") for i, x in enumerate(ds)]
    # The first axis of a design has one point in each of n intervals, so slabs of it are even.
    design = unit.join(limits, group).select(*group, "design_id", F.floor(F.col("d0") * blocks).cast("int").alias("_block"), F.array(*scaled).alias("_at"))
    design = settle(design)

    def visits(wanted: DataFrame, keep: int) -> DataFrame:
        def step(key: tuple, targets: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
            if targets.empty or boxes.empty:
                return pd.DataFrame({c: [] for c in (*group, "design_id", "_cell", "_at")})
            low, high, at = (np.array(c.tolist(), float) for c in (boxes["_low"], boxes["_high"], targets["_at"]))
            of, cell = _visits(low, high, boxes["_held"].to_numpy(), at, keep)
            found = targets[["design_id", "_at"]].iloc[of]
            return found.assign(_cell=boxes["_cell"].to_numpy()[cell], **{g: key[i] for i, g in enumerate(group)})[[*group, "design_id", "_cell", "_at"]]

        if boxes._rows == limits._rows:  # a cell for each group: nothing to choose from
            return wanted.join(small_side(boxes), group).select(*group, "design_id", "_cell", "_at")
        own = [*group, "_block"]
        seen = _renewed(boxes.join(wanted.select(*own).distinct(), group)).groupBy(*own)
        return settle(wanted.groupBy(*own).cogroup(seen).applyInPandas(step, f"{typed(*group)}, design_id long, _cell long, _at array<double>"))

    def nearest(wanted: DataFrame, keep: int) -> DataFrame:
        """``design_id, _block, _near``: the ids of the ``keep`` nearest rows, in order."""

        def step(key: tuple, rows: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or targets.empty:
                return pd.DataFrame({c: [] for c in (*group, "design_id", "_id", "_gap")})
            rows = rows.sort_values("_id", kind="stable")
            found = _nearest(rows["_id"].to_numpy(), np.array(rows["_x"].tolist(), float), np.array(targets["_at"].tolist(), float), keep)
            sizes = [len(ids) for ids, _ in found]
            ids, gaps = (np.concatenate(c) for c in zip(*found))
            return pd.DataFrame({**{g: key[i] for i, g in enumerate(group)}, "design_id": np.repeat(targets["design_id"].to_numpy(), sizes), "_id": ids, "_gap": gaps})

        asked = visits(wanted, keep)
        # Cells that some design point looks into; the others are not read.
        cells = boxes.select(*group, "_cell", "_slices")
        cells = settle(cells.join(asked.select(*group, "_cell").distinct(), [*group, "_cell"]))
        near = points
        if boxes._rows > limits._rows and cells._rows <= NAMED_CELLS:
            near = near.filter(F.col("_cell").isin([r["_cell"] for r in cells.select("_cell").distinct().collect()]))
        near = near.join(small_side(cells), [*group, "_cell"]).withColumn("_slice", F.pmod("_salt", "_slices"))
        sliced = asked.join(small_side(cells), [*group, "_cell"]).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)))
        part = [*group, "_cell", "_slice"]
        found = near.select(*part, "_id", "_x").groupBy(*part).cogroup(_renewed(sliced.select(*part, "design_id", "_at")).groupBy(*part)).applyInPandas(step, f"{typed(*group)}, design_id long, _id {kinds[id_col]}, _gap double")
        best = F.row_number().over(Window.partitionBy(*group, "design_id").orderBy("_gap", "_id"))
        listed = found.withColumn("_n", best).filter(F.col("_n") <= keep).groupBy(*group, "design_id").agg(F.array_sort(F.collect_list(F.struct("_gap", "_id"))).alias("_near"))
        return listed.join(wanted.select(*group, "design_id", "_block"), [*group, "design_id"]).select(*group, "design_id", "_block", F.col("_near._id").alias("_near"))

    def claims(lists: DataFrame, before: DataFrame | None) -> DataFrame:
        """``design_id, _id``: what every block claims, given what was claimed before."""

        def step(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return pd.DataFrame({c: [] for c in (*group, "design_id", "_block", "_id")})
            picks = _choose(rows["design_id"].to_numpy(), rows["_near"].tolist(), dict(zip(held["_id"], held["design_id"])))
            out = pd.DataFrame({**{g: key[i] for i, g in enumerate(group)}, "design_id": rows["design_id"].to_numpy(), "_block": rows["_block"].to_numpy()})
            return out.assign(_id=pd.Series(picks, dtype="Int64" if kinds[id_col] in ("bigint", "int") else object))

        own = [*group, "_block"]
        out = f"{typed(*group)}, design_id long, _block int, _id {kinds[id_col]}"
        asked = lists.select(*own, F.explode("_near").alias("_id")).distinct()
        if before is None:
            held = asked.limit(0).withColumn("design_id", F.lit(0).cast("long"))
        else:
            first = before.filter("_id IS NOT NULL").groupBy(*group, "_id").agg(F.min(F.struct("design_id", "_block")).alias("_of"))
            held = asked.join(first, [*group, "_id"]).filter(F.col("_of._block") != F.col("_block")).select(*own, "_id", "_of.design_id")
        return settle(lists.groupBy(*own).cogroup(_renewed(held).groupBy(*own)).applyInPandas(step, out))

    keep = min(keep or KEEP, n)
    lists, now = settle(nearest(design, keep)), None
    while True:
        state, rounds = None, 0
        while True:
            now, rounds = claims(lists, now), rounds + 1
            found = tuple(now.agg(F.bit_xor(F.xxhash64(*group, "design_id", "_id")), F.count(F.when(F.col("_id").isNull(), 1))).first())
            if blocks == 1 or found == state:
                break
            state = found
            if rounds % PATIENCE == 0:
                blocks = -(-blocks // 2)
                half = F.floor(F.col("_block") / 2).cast("int")
                lists, now = settle(lists.withColumn("_block", half)), now.withColumn("_block", half)
        if not found[1]:
            break
        keep = min(2 * keep, n)
        out_of = settle(now.filter("_id IS NULL").select(*group, "design_id", "_block"))
        wanted = design.drop("_block").join(small_side(out_of), [*group, "design_id"])
        rest = lists.join(small_side(out_of.drop("_block")), [*group, "design_id"], "left_anti")
        lists = settle(rest.unionByName(nearest(wanted, keep)))
    picks = now.select(*group, "design_id", F.col("_id").alias(id_col))
    return df.join(small_side(picks), [*group, id_col])
