"""Files in the formats the sources read, written by Spark from a table.

Used by the source queries and the tests.  A file holds one snapshot of a fixed
number of cells, so a task never holds more than that.
"""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def local_path(path: str) -> str:
    """The path as the operating system knows it."""
    return path.removeprefix("file://").removeprefix("file:")


def _replace(file: str, content: bytes) -> None:
    """Write under another name first: a retried task never leaves half a file."""
    os.makedirs(os.path.dirname(file), exist_ok=True)
    draft = f"{file}.{os.getpid()}.tmp"
    with open(draft, "wb") as out:
        out.write(content)
    os.replace(draft, file)


def _per_snapshot(df: DataFrame, keys: Sequence[str], step) -> None:
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        step(pdf)
        return pd.DataFrame({"files": [1]})

    df.groupBy(*keys).applyInPandas(write, "files long").count()


def write_grids(df: DataFrame, path: str, name_col: str, value_cols: Sequence[str], order_cols: Sequence[str]) -> None:
    """Flat float32 files; ``name_col`` holds a file name with ``{}`` for the
    variable; cells follow ``order_cols``; several columns joined by ``+`` are
    interleaved."""
    root = local_path(path)
    order = list(order_cols)

    def step(pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values(order, kind="stable")
        for spec in value_cols:
            variable, _, cols = spec.partition("=")
            values = pdf[(cols or variable).split("+")].to_numpy(dtype="<f4")
            _replace(os.path.join(root, pdf[name_col].iloc[0].replace("{}", variable)), values.tobytes())

    _per_snapshot(df, [name_col], step)


def write_npz(df: DataFrame, path: str, name_col: str, value_cols: Sequence[str], shape: tuple[int, int, int]) -> None:
    root = local_path(path)

    def step(pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values(["gx", "gy", "gz"], kind="stable")
        for c in value_cols:
            buffer = io.BytesIO()
            np.savez(buffer, datacube=pdf[c].to_numpy().reshape(shape))
            _replace(os.path.join(root, pdf[name_col].iloc[0].replace("{}", c)), buffer.getvalue())

    _per_snapshot(df, [name_col], step)


def write_npy(df: DataFrame, path: str, name_col: str, cols: Sequence[str], order_col: str) -> None:
    root = local_path(path)
    names = list(cols)

    def step(pdf: pd.DataFrame) -> None:
        buffer = io.BytesIO()
        np.save(buffer, pdf.sort_values(order_col)[names].to_numpy(dtype="float64"))
        _replace(os.path.join(root, pdf[name_col].iloc[0]), buffer.getvalue())

    _per_snapshot(df, [name_col], step)


def _foam_text(values: np.ndarray) -> bytes:
    kind = "scalar" if values.shape[1] == 1 else "vector"
    if kind == "scalar":
        lines = [repr(v) for v in values[:, 0].tolist()]
    else:
        lines = ["(" + " ".join(map(repr, v)) + ")" for v in values.tolist()]
    body = "\n".join(lines)
    return f"FoamFile\n{{\n    format ascii;\n}}\ninternalField   nonuniform List<{kind}>\n{len(values)}\n(\n{body}\n)\n;\n".encode()


def write_foam(df: DataFrame, path: str, time_col: str, fields: dict[str, Sequence[str]], order_col: str) -> None:
    root = local_path(path)

    def step(pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values(order_col)
        for name, cols in fields.items():
            content = gzip.compress(_foam_text(pdf[list(cols)].to_numpy(dtype="float64")))
            _replace(os.path.join(root, str(int(pdf[time_col].iloc[0])), f"{name}.gz"), content)

    _per_snapshot(df, [time_col], step)
