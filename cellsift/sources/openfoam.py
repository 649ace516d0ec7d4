"""OpenFOAM fields: gzip text, one file per (time, field).

Gzip cannot be split, so the files of one time are read by one task, and a task reads
several times where there are many. Files are decompressed
as streams, a piece of text at a time, and the values of all fields leave together
in batches: memory doesn't depend on the size or number of the files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.sources.files import located

ROWS_PER_BATCH = 262_144
#: Bytes of a file that are read, and of text that is parsed, at once.
CHUNK = 1 << 20
#: Tasks for each core that the session has, at most, however many times are read.
TASKS_PER_CORE = 32
# Field files, the columns each gives, and targets by name.
FIELDS = {"p": ("p",), "U": ("u", "v", "w"), "vorticity": ("wx", "wy", "wz"), "C": ("x", "y", "z")}
TARGETS = {"p": ("p",), "wz": ("wz",), "pwz": ("p", "wz"), "drag": ("drag",)}
_BLANK = bytes(32 if b in b"()" else b for b in range(256))
LIST_HEAD = rb"internalField\s+nonuniform\s+List<(scalar|vector)>\s*(\d+)\s*\("


def _text(path: str) -> Iterator[bytes]:
    """The text of a file, gzip or plain, piece by piece."""
    system, at = located(path)
    with system.open_input_file(at) as raw:
        data = raw.read(CHUNK)
        if data[:2] != b"\x1f\x8b":
            while data:
                yield data
                data = raw.read(CHUNK)
            return
        unpack = zlib.decompressobj(31)
        while data or unpack.unconsumed_tail:
            yield unpack.decompress(unpack.unconsumed_tail + data, CHUNK)
            if unpack.eof:  # another member may follow
                data, unpack = unpack.unused_data, zlib.decompressobj(31)
                data = data or raw.read(CHUNK)
            else:
                data = b"" if unpack.unconsumed_tail else raw.read(CHUNK)


def field_values(path: str) -> Iterator[np.ndarray]:
    """The internal field of a file as rows of one or three values, block by block."""
    pieces, text, head = _text(path), b"", None
    while head is None:
        more = next(pieces, None)
        if more is None or len(text) > 16 * CHUNK:
            raise ValueError(f"{path}: no ASCII internalField list found")
        text += more
        head = re.search(LIST_HEAD, text)
    width, count, seen = (3 if head.group(1) == b"vector" else 1), int(head.group(2)), 0
    text, ended = text[head.end() :], False
    while not ended:
        # A list of vectors ends at a bracket that follows another one.
        end = re.search(rb"\)\s*\)|^\s*\)" if width == 3 and not seen else rb"\)\s*\)" if width == 3 else rb"\)", text)
        more = None if end else next(pieces, None)
        if end or more is None:
            body, ended = text[: end.start()] if end else text, True
        else:
            cut = text.rfind(b"(") if width == 3 else max(text.rfind(b" "), text.rfind(b"\n"))
            body, text = text[: max(cut, 0)], text[max(cut, 0) :] + more
        found = np.array(body.translate(_BLANK).split(), dtype="float64")
        if found.size % width:
            raise ValueError(f"{path}: a vector has not three values")
        seen += found.size // width
        if found.size:
            yield found.reshape(-1, width)
    if seen != count:
        raise ValueError(f"{path}: field holds {seen} rows where {count} are announced")


def _wide(case: str, fields: Sequence[str]):
    """Task-side decoder: the field files of one time to rows with all columns."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                streams = {f: field_values(f"{case.rstrip('/')}/{row['timestep']}/{f}.gz") for f in fields}
                held = {f: np.empty((0, len(FIELDS[f]))) for f in fields}
                at, open_ = 0, set(fields)
                while open_ or any(len(h) for h in held.values()):
                    n = min(len(held[f]) for f in fields)
                    for f in [f for f in open_ if len(held[f]) == n]:  # those behind go on
                        more = next(streams[f], None)
                        if more is None:
                            open_.discard(f)
                        else:
                            held[f] = np.concatenate([held[f], more])
                    n = min(len(held[f]) for f in fields)
                    if not n:
                        if any(len(held[f]) and not all(g in open_ for g in fields if not len(held[g])) for f in fields):
                            raise ValueError(f"fields of time {row['timestep']} differ in length")
                        continue
                    for begin in range(0, n, ROWS_PER_BATCH):
                        end = min(n, begin + ROWS_PER_BATCH)
                        cols = {"timestep": pa.array(np.full(end - begin, row["timestep"])), "point_id": pa.array(np.arange(at + begin, at + end))}
                        for f in fields:
                            cols.update({name: pa.array(np.ascontiguousarray(held[f][begin:end, i])) for i, name in enumerate(FIELDS[f])})
                        yield pa.RecordBatch.from_pydict(cols)
                    at, held = at + n, {f: h[n:] for f, h in held.items()}

    return decode


def read_fields(spark: SparkSession, case: str, fields: Sequence[str], times: Sequence[int]) -> DataFrame:
    """Fields at whole times, one row per cell with a column per component.

    Only the files of the wanted times and fields are opened.  The files of one
    time are read by one task, side by side, and aligned by position.
    """
    if isinstance(times, range):
        wanted = spark.range(times.start, times.stop, times.step).withColumnRenamed("id", "timestep")
    else:
        wanted = spark.createDataFrame([(int(t),) for t in times], "timestep long")
    tasks = min(len(times), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    columns = ", ".join(f"{name} double" for f in fields for name in FIELDS[f])
    return wanted.repartition(max(1, tasks), "timestep").mapInArrow(_wide(case, list(fields)), f"timestep long, point_id long, {columns}")


def read_cells(spark: SparkSession, case: str) -> DataFrame:
    """Cell centres: ``point_id, x, y, z``."""
    return read_fields(spark, case, ["C"], [0]).drop("timestep")


def read_snapshots(spark: SparkSession, case: str, write_interval: int, num_timesteps: int) -> DataFrame:
    """Pressure, velocity and vorticity at times wi, 2 wi, ... as columns."""
    times = range(write_interval, write_interval * num_timesteps + 1, write_interval)
    return read_fields(spark, case, ["p", "U", "vorticity"], times)


def project(df: DataFrame, target: str, dims: int) -> DataFrame:
    """Inputs by dimension (u, v or u, v, w) and the columns of the target."""
    if dims not in (2, 3):
        raise ValueError("dims must be 2 or 3")
    return df.select("timestep", "point_id", *("u", "v", "w")[:dims], *[F.col(c).alias(f"target_{c}") for c in TARGETS[target]])
