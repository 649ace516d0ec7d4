"""Cell, box and coordinate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def int_div(col: str | Column, divisor: int) -> Column:
    """Floor division of whole numbers."""
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / F.lit(divisor)).cast("long")


def box_counts(grid: tuple[int, int, int], box: tuple[int, int, int], pad: int = 0) -> tuple[int, int, int]:
    """Complete boxes along each axis; ``pad`` cells at the end of x are unused."""
    nx, ny, nz = grid
    hx, hy, hz = box
    return (nx - pad) // hx, ny // hy, nz // hz


def with_box(df: DataFrame, box: tuple[int, int, int]) -> DataFrame:
    """Add the box of each cell as ``ix, iy, iz``."""
    return df.withColumns({f"i{a}": int_div(f"g{a}", h) for a, h in zip(AXES, box)})


def complete_boxes(df: DataFrame, grid: tuple[int, int, int], box: tuple[int, int, int], pad: int = 0) -> DataFrame:
    """Keep cells of complete boxes.  Written on gx, gy, gz so that it reaches
    the scan as plain range filters."""
    for axis, count, size in zip(AXES, box_counts(grid, box, pad), box):
        df = df.where(F.col(f"g{axis}") < count * size)
    return df


def box_number(counts: tuple[int, int, int]) -> Column:
    """Flat box number from ``ix, iy, iz``, x fastest."""
    num_x, num_y, _ = counts
    return (F.col("ix") + F.lit(num_x) * (F.col("iy") + F.lit(num_y) * F.col("iz"))).cast("long")


def box_from_number(number: str, counts: tuple[int, int, int]) -> dict[str, Column]:
    num_x, num_y, _ = counts
    flat = F.col(number)
    return {
        "ix": F.pmod(flat, F.lit(num_x)).cast("long"),
        "iy": F.pmod(int_div(flat, num_x), F.lit(num_y)).cast("long"),
        "iz": int_div(flat, num_x * num_y),
    }


def local_number(box: tuple[int, int, int]) -> Column:
    """Position of a cell inside its box, z fastest."""
    hx, hy, hz = box
    lx, ly, lz = (F.pmod(F.col(f"g{a}"), F.lit(h)) for a, h in zip(AXES, box))
    return ((lx * F.lit(hy) + ly) * F.lit(hz) + lz).cast("long")


def cell_from_local(local: str, box: tuple[int, int, int]) -> dict[str, Column]:
    """Global ``gx, gy, gz`` from ``ix, iy, iz`` and the position in the box."""
    hx, hy, hz = box
    flat = F.col(local)
    return {
        "gx": (F.col("ix") * hx + int_div(flat, hy * hz)).cast("long"),
        "gy": (F.col("iy") * hy + F.pmod(int_div(flat, hz), F.lit(hy))).cast("long"),
        "gz": (F.col("iz") * hz + F.pmod(flat, F.lit(hz))).cast("long"),
    }


def strided(df: DataFrame, skips: tuple[int, int, int], offsets: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Every k-th cell along each axis, counted from an offset.  The modulus is
    global, so the kept cells do not depend on how the scan was split."""
    for axis, skip, start in zip(AXES, skips, offsets):
        cell = F.col(f"g{axis}")
        if start:
            df = df.where(cell >= start)
        if skip > 1:
            df = df.where(F.pmod(cell - start, F.lit(skip)) == 0)
    return df


def cropped(df: DataFrame, origin: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """Cells of the box that starts at ``origin``."""
    for axis, start, length in zip(AXES, origin, size):
        df = df.where(F.col(f"g{axis}").between(start, start + length - 1))
    return df


def without_padding(df: DataFrame, nx: int, pad: int) -> DataFrame:
    """Drop the last ``pad`` cells of x."""
    return df.where(F.col("gx") < nx - pad)


def yz_plane(df: DataFrame, timestep, gx: int, variable: str) -> DataFrame:
    """The y-z plane of one variable at fixed x and timestep."""
    return df.where((F.col("timestep") == timestep) & (F.col("gx") == gx)).select("gy", "gz", variable)


def axis_coordinate(index: Column, length: float, n_full: int, n_out: int, offset: int = 0, skip: int = 1) -> Column:
    """Coordinate of the ``index``-th kept cell: ``n_out`` evenly spaced values
    from the first kept cell to the far end of the kept range, both included."""
    step = length / n_full
    first = step * offset
    last = first + step * n_out * skip
    if n_out == 1:
        return F.lit(first) + index * F.lit(0.0)
    return F.lit(first) + index * F.lit((last - first) / (n_out - 1))


def with_coordinates(df: DataFrame, params) -> DataFrame:
    """Add x, y, z; the vertical length lies on the gravity axis."""
    if params.gravity not in ("y", "z"):
        raise ValueError("gravity must be 'y' or 'z'")
    lengths = {"x": params.Lh, "y": params.Lh, "z": params.Lh, params.gravity: params.Lv}
    full = {"x": params.nx - params.pad, "y": params.ny, "z": params.nz}
    out = dict(zip(AXES, params.box))
    offset = {"x": params.nxoffset, "y": params.nyoffset, "z": params.nzoffset}
    skip = {"x": params.nxskip, "y": params.nyskip, "z": params.nzskip}
    return df.withColumns(
        {
            a: axis_coordinate(
                (F.col(f"g{a}") - offset[a]) / F.lit(skip[a]), lengths[a], full[a], out[a], offset[a], skip[a]
            )
            for a in AXES
        }
    )


def with_grid_coordinates(df: DataFrame, params) -> DataFrame:
    """Add x, y, z of cells of the whole grid, which spans its lengths evenly."""
    if params.gravity not in ("y", "z"):
        raise ValueError("gravity must be 'y' or 'z'")
    lengths = {"x": params.Lh, "y": params.Lh, "z": params.Lh, params.gravity: params.Lv}
    cells = {"x": params.nx - params.pad, "y": params.ny, "z": params.nz}
    return df.withColumns({a: axis_coordinate(F.col(f"g{a}"), lengths[a], cells[a], cells[a]) for a in AXES})


def unit_coordinate(local: Column, n: int) -> Column:
    """Coordinate in the unit cube of the ``local``-th of ``n`` cells."""
    return local / F.lit(float(max(n - 1, 1)))


def block_origin(file_no: Column, block: Column, in_block_dir: Column, blocks: int, block_size: int) -> dict[str, Column]:
    """First cell of the box a block file covers, from its running number.

    A file that already lies in its block's folder gets no shift along x.
    """
    return {
        "x0": F.when(in_block_dir, F.lit(0)).otherwise(block * F.lit(block_size)).cast("long"),
        "y0": (F.pmod(int_div(file_no, blocks), F.lit(blocks)) * F.lit(block_size)).cast("long"),
        "z0": (F.pmod(file_no, F.lit(blocks)) * F.lit(block_size)).cast("long"),
    }
