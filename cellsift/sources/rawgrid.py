"""Raw float32 grids as a Spark data source.

``spark.read.format("rawgrid").options(...).load(path)`` gives one row per cell:
``timestep, gx, gy, gz`` and one float column per variable.  Filters on the timestep
and on the slowest axis drop partitions and planes before a byte is read. An input
partition is a slab along the slowest axis, a stretch of rows of a plane that is
larger, or several small snapshots. Of a crop only the runs of cells along the
fastest axis are read, and a batch is part of a plane where a plane is large. A stride along the
fastest axis is taken in memory. Paths may have the scheme of any
file system that pyarrow knows.

Options
    layout      flat       <var>_<time with six decimals>
                var_dir    <var>/cube_<prefix>.<number>
                block_dir  <block>/cube_<prefix>.<number>, timestep = block
    vars        comma list of variables (directories of others are not listed)
    vectors     comma list of those that hold three values per cell
    nx, ny, nz  grid size, padding included
    axis_order  slowest to fastest axis, ``zyx`` by default
    pad         cells dropped at the end of x
    skips       strides "kx,ky,kz"; offsets "ox,oy,oz"; sizes "mx,my,mz"
    blocks      block_dir: blocks per axis
    cubes       block_dir: cubes in each file, one after the other. In a folder with a number
                the cube of that number is read; in others every cube is,
                with its number as timestep and as place along x
    slab        planes per input partition; where these would be more than SLABS, small
                ones share a partition as small snapshots do
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from cellsift.session import settle
from cellsift.sources.files import RangeFile, entries, read_runs

# File prefixes of named variables, and bytes per value.
PREFIXES = {"enstrophy": "enst", "velocity": "uvw", "pressure": "p", "dissipation": "diss"}
VALUE_BYTES = 4
ROWS_PER_BATCH = 262_144
CELLS_PER_TASK = 4_000_000
SLAB_BYTES = 256 * 1024 * 1024
#: Snapshots that are smaller share an input partition up to so many bytes.
PACK_BYTES = 16 * 1024 * 1024
#: What the opening of a file counts for there.
OPEN_BYTES = 16 * 1024
#: Input partitions of given slabs that are left as they are.
SLABS = 64


@dataclass
class Piece:
    """Planes ``start .. stop`` along the slowest axis of one snapshot, and of them the
    rows ``low .. high`` along the middle axis."""

    timestep: float
    files: dict
    start: int
    stop: int
    low: int
    high: int
    file_no: int = 0
    origin: tuple = (0, 0, 0)
    cube: int = 0


@dataclass
class Pieces(InputPartition):
    pieces: list


def _three(text: str | None, default: int | None) -> tuple:
    if not text:
        return (default, default, default)
    return tuple(int(p) for p in text.split(","))


class GridLayout:
    """What the options say about the files."""

    def __init__(self, options: dict):
        opt = {k.lower(): v for k, v in options.items()}
        self.path = opt["path"]
        self.layout = opt.get("layout", "flat")
        self.vars = [v.strip() for v in opt["vars"].split(",")]
        self.vectors = {v.strip() for v in opt.get("vectors", "").split(",") if v.strip()}
        self.grid = {"x": int(opt["nx"]), "y": int(opt["ny"]), "z": int(opt["nz"])}
        self.order = opt.get("axis_order", "yzx" if self.layout == "block_dir" else "zyx")
        self.pad = int(opt.get("pad", 0))
        self.skip = dict(zip("xyz", _three(opt.get("skips"), 1)))
        self.offset = dict(zip("xyz", _three(opt.get("offsets"), 0)))
        self.size = dict(zip("xyz", _three(opt.get("sizes"), None)))
        self.blocks = int(opt.get("blocks", 8))
        self.cubes = int(opt.get("cubes", 1))
        self.skip_incomplete = str(opt.get("skip_incomplete", False)).lower() == "true"
        self.slab = int(opt["slab"]) if "slab" in opt else None
        self.time_type = T.DoubleType() if self.layout == "flat" else T.LongType()
        if self.layout == "block_dir":
            self.grid["x"] //= self.blocks

    def columns(self) -> list[str]:
        return [name for v in self.vars for name in self.names(v)]

    def schema(self) -> T.StructType:
        fields = [T.StructField("timestep", self.time_type)]
        if self.layout == "block_dir":
            fields.append(T.StructField("file_no", T.LongType()))
        fields += [T.StructField(f"g{a}", T.LongType()) for a in "xyz"]
        fields += [T.StructField(c, T.FloatType()) for c in self.columns()]
        return T.StructType(fields)

    def names(self, variable: str) -> list[str]:
        return [f"{variable}_{a}" for a in "xyz"] if variable in self.vectors else [variable]

    def file_of(self, variable: str, timestep) -> str:
        if self.layout == "flat":
            return f"{self.path.rstrip('/')}/{variable}_{timestep:.6f}"
        return f"{self.path.rstrip('/')}/{variable}/cube_{PREFIXES.get(variable, variable)}.{int(timestep)}"

    def open(self, variable: str, path: str) -> RangeFile:
        """The file, its size checked."""
        expected = self.cube_bytes(variable) * self.cubes
        file = RangeFile(path)
        if file.size != expected:
            raise ValueError(f"{path}: {file.size} bytes where the grid needs {expected}")
        return file

    def cube_bytes(self, variable: str) -> int:
        return self.grid["x"] * self.grid["y"] * self.grid["z"] * self.cell_bytes(variable)

    def cell_bytes(self, variable: str) -> int:
        return VALUE_BYTES * len(self.names(variable))

    def cells(self, file: RangeFile, variable: str, planes: np.ndarray, rows: np.ndarray, fast: np.ndarray, cube: int = 0) -> np.ndarray:
        """Values of the cells at all ``planes`` x ``rows`` x ``fast``: a row for each
        cell, a column for each component. All three rise."""
        size, (_, mid, quick) = self.cell_bytes(variable), self.order
        lines = (planes[:, None] * self.grid[mid] + rows).ravel()
        first, span = int(fast[0]), int(fast[-1] - fast[0]) + 1
        starts = (lines * self.grid[quick] + first) * size + cube * self.cube_bytes(variable)
        data = read_runs(file, starts, span * size).view("<f4").reshape(len(lines), span, -1)
        return data[:, fast - first].reshape(len(lines) * len(fast), -1)

    @staticmethod
    def batches(planes: np.ndarray, rows: np.ndarray, fast: np.ndarray) -> Iterator[tuple]:
        """Parts of up to ROWS_PER_BATCH cells, whatever the size of a plane or of a row."""
        for f in range(0, len(fast), ROWS_PER_BATCH):
            some = fast[f : f + ROWS_PER_BATCH]
            lines = max(1, ROWS_PER_BATCH // len(some))
            step = max(1, lines // len(rows)) if len(rows) else 1
            for p in range(0, len(planes), step):
                for r in range(0, len(rows), lines):
                    yield planes[p : p + step], rows[r : r + lines], some

    def wanted(self, axis: str) -> np.ndarray:
        """Cells kept along an axis: crop, stride and padding together."""
        end = self.grid[axis] - (self.pad if axis == "x" else 0)
        if self.size[axis] is not None:
            end = min(end, self.offset[axis] + self.size[axis] * self.skip[axis])
        return np.arange(self.offset[axis], end, self.skip[axis])

    def sources(self) -> Iterator[tuple]:
        """(timestep, file number, files by variable, origin, cube in the file) of every snapshot."""
        found: dict = {}
        if self.layout == "flat":
            for name, path, _ in entries(self.path):
                for v in self.vars:
                    hit = re.fullmatch(re.escape(v) + r"_([0-9]+\.[0-9]+)", name)
                    if hit:
                        found.setdefault((float(hit.group(1)), 0, ""), {})[v] = path
        else:
            folders = sorted(name for name, _, folder in entries(self.path) if folder)
            folders = [f for f in folders if f in self.vars] if self.layout == "var_dir" else [f for f in folders if f.isdigit() or self.cubes > 1]
            for d in folders:
                files = entries(f"{self.path.rstrip('/')}/{d}")
                for v in [d] if self.layout == "var_dir" else self.vars:
                    pattern = r"cube_" + re.escape(PREFIXES.get(v, v)) + r"\.(\d+)"
                    for name, path, _ in files:
                        hit = re.fullmatch(pattern, name)
                        if hit:
                            number = int(hit.group(1))
                            key = (number, 0, "") if self.layout == "var_dir" else (int(d) if d.isdigit() else 0, number, d)
                            found.setdefault(key, {})[v] = path
        for (time, number, folder), files in sorted(found.items()):
            if len(files) < len(self.vars):
                if self.skip_incomplete:
                    continue
                raise ValueError(f"snapshot {time} has no {sorted(set(self.vars) - set(files))}; skip_incomplete=True leaves it out")
            origin = {"x": 0, "y": 0, "z": 0}
            if self.layout == "block_dir":
                step = self.grid["x"]
                origin["y"] = number // self.blocks % self.blocks * step
                origin["z"] = number % self.blocks * step
            if folder and not folder.isdigit():
                for cube in range(self.cubes):
                    yield cube, number, files, {**origin, "x": cube * self.grid["x"]}, cube
            elif self.cubes == 1:
                yield time, number, files, origin, 0
            elif time < self.cubes:
                yield time, number, files, origin, time


class RawGridReader(DataSourceReader):
    def __init__(self, layout: GridLayout, schema: T.StructType):
        self.layout = layout
        self.schema = schema
        self.time_tests: list = []
        self.plane_tests: list = []

    def pushFilters(self, filters: list[Filter]):
        slow = f"g{self.layout.order[0]}"
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            if isinstance(f, kinds) and name == "timestep":
                self.time_tests.append(f)
            elif isinstance(f, kinds) and name == slow:
                self.plane_tests.append(f)
            # Pruning is by file and plane; Spark keeps the exact filter.
            yield f

    @staticmethod
    def _passes(value, tests) -> bool:
        for f in tests:
            if isinstance(f, EqualTo):
                ok = value == f.value
            elif isinstance(f, In):
                ok = value in f.value
            elif isinstance(f, GreaterThan):
                ok = value > f.value
            elif isinstance(f, GreaterThanOrEqual):
                ok = value >= f.value
            elif isinstance(f, LessThan):
                ok = value < f.value
            else:
                ok = value <= f.value
            if not ok:
                return False
        return True

    def _kept(self, origin: dict) -> dict:
        """Cells of a snapshot's files along each axis."""
        lay = self.layout
        shift = lambda a: origin[a] if lay.layout == "block_dir" and lay.size[a] is not None and a != "x" else 0
        keep = {a: lay.wanted(a) + shift(a) for a in "xyz"}
        return {a: k[k < lay.grid[a]] for a, k in keep.items()}

    def partitions(self):
        lay = self.layout
        slow, mid, fast = lay.order
        found = []
        for time, number, files, origin, cube in lay.sources():
            if not self._passes(time, self.time_tests):
                continue
            keep = self._kept(origin)
            lift = origin["x"] if slow == "x" else 0  # cubes of a file follow each other along x
            planes = [int(p) for p in keep[slow] if self._passes(int(p) + lift, self.plane_tests)]
            if not planes or not len(keep[mid]) or not len(keep[fast]):
                continue
            line = VALUE_BYTES * len(lay.columns()) * int(keep[fast][-1] - keep[fast][0] + 1)
            plane = line * len(keep[mid])
            slab = lay.slab or max(1, SLAB_BYTES // plane)
            lines = len(keep[mid]) if plane <= SLAB_BYTES else max(1, SLAB_BYTES // line)
            chunks: dict = {}
            for i, p in enumerate(planes):
                chunks.setdefault(p // slab if lay.slab else i // slab, []).append(p)
            for chunk in chunks.values():
                for r in range(0, len(keep[mid]), lines):
                    rows = keep[mid][r : r + lines]
                    piece = Piece(time, files, chunk[0], chunk[-1] + 1, int(rows[0]), int(rows[-1]) + 1, number, tuple(origin[a] for a in "xyz"), cube)
                    found.append((line * len(rows) * len(chunk) + OPEN_BYTES * len(files), piece))
        apart = lay.slab and len(found) <= SLABS
        out, held = [], 0
        for size, piece in found:
            if out and not apart and held + size <= PACK_BYTES:
                out[-1].pieces.append(piece)
                held += size
            else:
                out.append(Pieces([piece]))
                held = size
        return out or [Pieces([])]

    def read(self, partition: Pieces):
        for piece in partition.pieces:
            yield from self._read(piece)

    def _read(self, piece: Piece):
        lay = self.layout
        origin = dict(zip("xyz", piece.origin))
        keep = self._kept(origin)
        slow, mid, fast = lay.order
        planes = keep[slow][(keep[slow] >= piece.start) & (keep[slow] < piece.stop)]
        rows = keep[mid][(keep[mid] >= piece.low) & (keep[mid] < piece.high)]
        files = {v: lay.open(v, path) for v, path in piece.files.items()}
        arrow_schema = _arrow_schema(self.schema)
        for some in lay.batches(planes, rows, keep[fast]):
            grids = np.meshgrid(*some, indexing="ij")
            at = {a: g.ravel() for a, g in zip(lay.order, grids)}
            n = len(at[slow])
            cols = {"timestep": np.full(n, piece.timestep), "file_no": np.full(n, piece.file_no)}
            cols.update({f"g{a}": at[a] + (origin["x"] if a == "x" else 0) for a in "xyz"})
            for v, file in files.items():
                cols.update(zip(lay.names(v), lay.cells(file, v, *some, piece.cube).T))
            arrays = [pa.array(np.ascontiguousarray(cols[f.name])).cast(f.type) for f in arrow_schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)
        for file in files.values():
            file.close()


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.LongType: pa.int64()}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema.fields])


class RawGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawgrid"

    def schema(self):
        return GridLayout(self.options).schema()

    def reader(self, schema):
        return RawGridReader(GridLayout(self.options), schema)


def read_raw_grid(spark: SparkSession, path: str, variables, grid: tuple[int, int, int], **options) -> DataFrame:
    """Register the source and read; keyword options as in the module text."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawGrid)
    text = {k: ",".join(str(x) for x in v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items()}
    return (
        spark.read.format("rawgrid")
        .options(vars=",".join(variables), nx=grid[0], ny=grid[1], nz=grid[2], **text)
        .load(path)
    )


def _layout(path: str, variables, grid, options: dict) -> GridLayout:
    text = {k: ",".join(str(x) for x in v) if isinstance(v, (list, tuple)) else str(v) for k, v in options.items()}
    return GridLayout({"path": path, "vars": ",".join(variables), "nx": grid[0], "ny": grid[1], "nz": grid[2], **text})


def grid_times(spark: SparkSession, path: str, variables, grid, **options) -> DataFrame:
    """Timesteps that have every variable, from the file names alone."""
    layout = _layout(path, variables, grid, options)
    kind = "double" if layout.layout == "flat" else "long"
    return spark.createDataFrame([(t,) for t in sorted({s[0] for s in layout.sources()})], f"timestep {kind}")


def read_boxes(spark: SparkSession, path: str, variables, grid, box, chosen: DataFrame, **options) -> DataFrame:
    """Cells of chosen boxes only, layouts ``flat`` and ``var_dir``.

    The box table is spread over tasks, and each task seeks to the rows of its
    boxes, of which at most twice the bytes are read.  Rows as of ``read_raw_grid`` with
    ``ix, iy, iz``.
    """
    layout = _layout(path, variables, grid, options)
    schema = T.StructType([*[T.StructField(f"i{a}", T.LongType()) for a in "xyz"], *layout.schema().fields])
    arrow_schema = _arrow_schema(schema)
    size = dict(zip("xyz", box))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                span = [np.arange(row[f"i{a}"] * size[a], (row[f"i{a}"] + 1) * size[a]) for a in layout.order]
                files = {v: layout.open(v, layout.file_of(v, row["timestep"])) for v in layout.vars}
                for some in layout.batches(*span):
                    grids = np.meshgrid(*some, indexing="ij")
                    cols = {f"g{a}": g.ravel() for a, g in zip(layout.order, grids)}
                    n = grids[0].size
                    cols |= {"timestep": np.full(n, row["timestep"]), **{f"i{a}": np.full(n, row[f"i{a}"]) for a in "xyz"}}
                    for v, file in files.items():
                        cols.update(zip(layout.names(v), layout.cells(file, v, *some).T))
                    arrays = [pa.array(np.ascontiguousarray(cols[f.name])).cast(f.type) for f in arrow_schema]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow_schema)
                for file in files.values():
                    file.close()

    # The box table is tiny, the cells behind it are not: the number of tasks is
    # set by the cells, so that adaptive execution does not merge them into one.
    boxes = settle(chosen.select("timestep", "ix", "iy", "iz"))
    by_size = -(-boxes._rows * int(np.prod(box)) // CELLS_PER_TASK)
    tasks = max(by_size, min(boxes._rows, spark.sparkContext.defaultParallelism), 1)
    return boxes.repartition(tasks, "timestep", "ix", "iy", "iz").mapInArrow(read, schema)
