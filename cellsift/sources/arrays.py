"""NPZ and NPY array files.

A file's header tells where each array lies, so stored arrays are read by stretches of
cells, many tasks to a file. Compressed members can't be entered in the
middle: they are decoded as streams, a snapshot to a task, a block of cells at a time.
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.functions.scalars import TIME_IN_NPZ_NAME, time_from_name
from cellsift.session import settle
from cellsift.sources.files import RangeFile, located

ROWS_PER_BATCH = 262_144
#: Cells of a stretch, which a task reads by itself.
STRETCH = 4_000_000
HEAD_BYTES = 65_536
# Variable name at the head of a file name, roles by default.
NPZ_VARIABLE = r"([^/_]+)_[^/]*$"
NPZ_INPUTS = ("u", "v", "w", "r")
NPZ_TARGET = "p"
NPZ_CLUSTER = "pv"
_LOCAL_HEAD = 30  # bytes of a zip member's own head, before its name
_LAYOUT = "offset long, shape array<long>, fortran boolean, kind string"


def array_layout(head: bytes) -> tuple[int, tuple, bool, np.dtype]:
    """Length of the header, shape, whether the first axis varies fastest, and type."""
    text = io.BytesIO(head)
    version = np.lib.format.read_magic(text)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(text)
    if kind.hasobject:
        raise ValueError("arrays of Python objects are not read")
    return text.tell(), shape, fortran, kind


def _member_layout(path: str, name: str) -> tuple[int, tuple, bool, np.dtype]:
    """Where a member's values lie in an archive; offset -1 if it is compressed."""
    system, at = located(path)
    with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
        info = archive.getinfo(name)
        with archive.open(info) as member:
            size, shape, fortran, kind = array_layout(member.read(HEAD_BYTES))
        if info.compress_type != zipfile.ZIP_STORED:
            return -1, shape, fortran, kind
        head = raw.read_at(_LOCAL_HEAD, info.header_offset)
        begin = info.header_offset + _LOCAL_HEAD + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        return begin + size, shape, fortran, kind


def _planned(files: DataFrame, layout) -> DataFrame:
    """``files`` (with ``path``) and the layout of each one's array, from its header alone."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [layout(path) for path in batch.column("path").to_pylist()]
            more = [pa.array([f[0] for f in found], pa.int64()), pa.array([list(f[1]) for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.bool_()), pa.array([f[3].str for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "offset", "shape", "fortran", "kind"])

    return files.mapInArrow(plan, f"{kinds}, {_LAYOUT}")


def _stretches(plan: DataFrame, size: str) -> DataFrame:
    """A row for each stretch ``begin .. end`` of a plan's ``size`` cells, spread over tasks."""
    cuts = plan.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(size) - 1, F.lit(0)).cast("long"), F.when(F.col("whole"), F.greatest(F.expr(size), F.lit(1))).otherwise(F.lit(STRETCH)).cast("long"))))
    cuts = settle(cuts.withColumn("end", F.least(F.expr(size), F.col("begin") + F.when(F.col("whole"), F.expr(size)).otherwise(F.lit(STRETCH)))))
    tasks = max(1, min(cuts._rows, max(plan.sparkSession.sparkContext.defaultParallelism, cuts._rows // 4)))
    return cuts.repartition(tasks, *[c for c in ("timestep", "path") if c in cuts.columns], "begin")


def _values(file: dict, begin: int, end: int) -> Iterator[np.ndarray]:
    """Values ``begin .. end`` of an array in the order of its file, in blocks."""
    kind = np.dtype(file["kind"])
    if file["offset"] >= 0:
        data = RangeFile(file["path"])
        for at in range(begin, end, ROWS_PER_BATCH):
            n = min(ROWS_PER_BATCH, end - at)
            yield np.frombuffer(data.read(file["offset"] + at * kind.itemsize, n * kind.itemsize), kind)
        data.close()
        return
    system, at = located(file["path"])
    with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive, archive.open("datacube.npy") as member:
        head = member.read(HEAD_BYTES)
        left = head[array_layout(head)[0] :]
        for at in range(begin, end, ROWS_PER_BATCH):
            n = min(ROWS_PER_BATCH, end - at) * kind.itemsize
            while len(left) < n:
                more = member.read(n - len(left))
                if not more:
                    raise ValueError(f"{file['path']}: the array ends early")
                left += more
            yield np.frombuffer(left[:n], kind)
            left = left[n:]


def _wide(variables: Sequence[str]):
    """Task-side decoder: a stretch of a snapshot to rows with a column for each variable."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files = {f["variable"]: f for f in row["files"]}
                if len({(tuple(f["shape"]), f["fortran"]) for f in files.values()}) > 1:
                    raise ValueError(f"arrays of snapshot {row['timestep']} differ in shape or order")
                (nx, ny, nz), fortran = files[variables[0]]["shape"], files[variables[0]]["fortran"]
                at = row["begin"]
                for parts in zip(*(_values(files[v], row["begin"], row["end"]) for v in variables)):
                    index = np.arange(at, at + len(parts[0]))
                    at += len(index)
                    x, y, z = (index % nx, index // nx % ny, index // (nx * ny)) if fortran else (index // (ny * nz), index // nz % ny, index % nz)
                    cells = {"timestep": np.full(len(index), row["timestep"]), "point_id": (x * ny + y) * nz + z, "gx": x, "gy": y, "gz": z}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cells.items()} | {v: pa.array(p.astype("float64")) for v, p in zip(variables, parts)})

    return decode


def npz_snapshots(spark: SparkSession, path: str, variables: Sequence[str], skip_incomplete: bool = False) -> DataFrame:
    """One row per cell with a column per variable, from ``datacube`` files.

    A task reads the same stretch of all variables, so cells are aligned by
    position and never shuffled.  A snapshot that misses a variable
    or has one twice is an error; ``skip_incomplete`` leaves it out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    named = files.select(
        time_from_name(F.col("path"), TIME_IN_NPZ_NAME).alias("timestep"),
        F.regexp_extract("path", NPZ_VARIABLE, 1).alias("variable"),
        "path",
    ).where(F.col("timestep").isNotNull() & F.col("variable").isin(list(variables)))
    found = F.array_sort(F.col("files.variable")) == F.array(*[F.lit(v) for v in sorted(variables)])
    if not skip_incomplete:
        wrong = F.raise_error(F.concat(F.lit("variables of snapshot "), F.col("timestep").cast("string"), F.lit(" are not complete")))
        found = F.when(found, True).otherwise(wrong.cast("boolean"))
    planned = _planned(named, lambda file: _member_layout(file, "datacube.npy"))
    whole = planned.groupBy("timestep").agg(F.collect_list(F.struct("variable", "path", "offset", "shape", "fortran", "kind")).alias("files"))
    whole = whole.where(found).withColumn("whole", F.array_min("files.offset") < 0)
    cut = _stretches(whole, "files[0].shape[0] * files[0].shape[1] * files[0].shape[2]")
    columns = ", ".join(f"{v} double" for v in variables)
    return cut.mapInArrow(_wide(list(variables)), f"timestep double, point_id long, gx long, gy long, gz long, {columns}")


def _axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with np.load(io.BytesIO(row["content"]), allow_pickle=False) as data:
                for axis in ("x", "y", "z"):
                    values = np.asarray(data[axis], dtype="float64")
                    yield pa.RecordBatch.from_pydict(
                        {"axis": pa.array([axis] * values.size), "at": pa.array(np.arange(values.size)), "coordinate": pa.array(values)}
                    )


def read_npz_axes(spark: SparkSession, file: str) -> DataFrame:
    """Axis coordinates of an axis file: ``axis, at, coordinate``."""
    files = spark.read.format("binaryFile").load(file).select("content")
    return files.mapInArrow(_axes, "axis string, at long, coordinate double")


def _cloud_layout(path: str) -> tuple[int, tuple, bool, np.dtype]:
    file = RangeFile(path)
    size, shape, fortran, kind = array_layout(file.read(0, min(HEAD_BYTES, file.size)))
    file.close()
    if len(shape) != 2 or shape[1] < 2 or size + math.prod(shape) * kind.itemsize > file.size:
        raise ValueError(f"{path}: no whole array of two columns")
    return size, shape, fortran, kind


def _cloud(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file, kind, (rows, columns) = RangeFile(row["path"]), np.dtype(row["kind"]), row["shape"]
            for at in range(row["begin"], row["end"], ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, row["end"] - at)
                if row["fortran"]:
                    x = [np.frombuffer(file.read(row["offset"] + (c * rows + at) * kind.itemsize, n * kind.itemsize), kind) for c in (0, 1)]
                else:
                    data = file.read(row["offset"] + at * columns * kind.itemsize, n * columns * kind.itemsize)
                    x = np.frombuffer(data, kind).reshape(n, columns).T[:2]
                cols = {"path": pa.array([row["path"]] * n), "point_id": pa.array(np.arange(at, at + n))}
                yield pa.RecordBatch.from_pydict(cols | {f"x{c}": pa.array(x[c].astype("float64")) for c in (0, 1)})
            file.close()


def read_npy_cloud(spark: SparkSession, path: str) -> DataFrame:
    """Two-column point cloud.  Both columns are inputs; the first is also the
    target ``y`` and the cluster variable ``cv``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path")
    cut = _stretches(_planned(files, _cloud_layout).withColumn("whole", F.lit(False)), "shape[0]")
    cloud = cut.mapInArrow(_cloud, "path string, point_id long, x0 double, x1 double")
    return cloud.withColumns({"y": F.col("x0"), "cv": F.col("x0")})
