"""File formats, on small generated files."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsift.params import CurationParams
from cellsift.sources import arrays, formats, listing, openfoam, rawgrid, tabular

NX, NY, NZ = 10, 6, 8
TIMES = (28.04, 28.24, 28.44)


def cube(t):
    z, y, x = np.meshgrid(range(NZ), range(NY), range(NX), indexing="ij")
    return (1000 * z + 10 * y + x + 0.1 * t).astype("<f4")


@pytest.fixture
def raw(tmp_path):
    for i, t in enumerate(TIMES):
        for k, v in enumerate(("u", "p", "pv")):
            (cube(i) + k).tofile(tmp_path / f"{v}_{t:.6f}")
    return str(tmp_path)


def test_raw_grid_axes_padding_and_values(spark, raw):
    df = rawgrid.read_raw_grid(spark, raw, ["u", "p"], (NX, NY, NZ), pad=2, slab=3)
    rows = df.toPandas()
    assert len(rows) == 3 * 8 * NY * NZ and rows.gx.max() == 7
    index = rows.timestep.map({t: i for i, t in enumerate(TIMES)})
    want = 1000 * rows.gz + 10 * rows.gy + rows.gx + 0.1 * index
    assert np.allclose(rows.u, want, atol=1e-3) and np.allclose(rows.p, want + 1, atol=1e-3)


def test_filters_reach_the_reader(spark, raw):
    df = rawgrid.read_raw_grid(spark, raw, ["u"], (NX, NY, NZ), slab=2)
    assert df.rdd.getNumPartitions() == 12
    one = df.where((F.col("timestep") == 28.24) & (F.col("gz") >= 4))
    assert one.rdd.getNumPartitions() == 2
    assert one.count() == NX * NY * 4
    assert df.where(F.col("timestep") > 99).count() == 0


def test_many_small_slabs_share_partitions(spark, tmp_path):
    """Partitions grow with the cells and files of given slabs, not with the number of slabs."""
    for t in range(600):
        np.arange(16, dtype="<f4").tofile(tmp_path / f"u_{t}.500000")
    df = rawgrid.read_raw_grid(spark, str(tmp_path), ["u"], (2, 2, 4), skips=(1, 2, 1), slab=2)
    assert df.rdd.getNumPartitions() <= 10
    rows = df.groupBy("timestep").agg(F.count("u").alias("n"), F.sum("u").alias("total"), F.count_distinct("gz").alias("planes")).toPandas()
    assert len(rows) == 600 and set(rows.n) == {8} and set(rows.total) == {52.0} and set(rows.planes) == {4}


@pytest.mark.parametrize("order", ["zyx", "xyz", "yzx"])
def test_axis_orders(spark, tmp_path, order):
    base = cube(0)  # (z, y, x)
    moved = np.transpose(base, ["zyx".index(a) for a in order])
    np.ascontiguousarray(moved).tofile(tmp_path / "u_1.000000")
    rows = rawgrid.read_raw_grid(spark, str(tmp_path), ["u"], (NX, NY, NZ), axis_order=order).toPandas()
    assert np.allclose(rows.u, 1000 * rows.gz + 10 * rows.gy + rows.gx)
    chosen = spark.createDataFrame([(1.0, 1, 0, 1)], "timestep double, ix long, iy long, iz long")
    cells = rawgrid.read_boxes(spark, str(tmp_path), ["u"], (NX, NY, NZ), (5, 3, 4), chosen, axis_order=order).toPandas()
    assert len(cells) == 60 and cells.gx.min() == 5 and cells.gz.min() == 4
    assert np.allclose(cells.u, 1000 * cells.gz + 10 * cells.gy + cells.gx)


def test_strided_sub_box(spark, raw):
    rows = rawgrid.read_raw_grid(
        spark, raw, ["u"], (NX, NY, NZ), offsets=(1, 2, 0), sizes=(3, 2, 4), skips=(2, 1, 2)
    ).toPandas()
    assert sorted(rows.gx.unique()) == [1, 3, 5] and sorted(rows.gy.unique()) == [2, 3] and sorted(rows.gz.unique()) == [0, 2, 4, 6]


def test_wrong_size_and_missing_variable(spark, raw):
    os.truncate(f"{raw}/u_{TIMES[0]:.6f}", 40)
    with pytest.raises(Exception, match="bytes where the grid needs"):
        rawgrid.read_raw_grid(spark, raw, ["u"], (NX, NY, NZ)).count()
    (cube(0)).tofile(f"{raw}/w_{TIMES[1]:.6f}")
    with pytest.raises(Exception, match="skip_incomplete"):
        rawgrid.read_raw_grid(spark, raw, ["p", "w"], (NX, NY, NZ)).count()
    both = rawgrid.read_raw_grid(spark, raw, ["p", "w"], (NX, NY, NZ), skip_incomplete=True)
    assert [r[0] for r in both.select("timestep").distinct().collect()] == [TIMES[1]]
    sizes = listing.list_files(spark, raw, "u_*")
    with pytest.raises(Exception, match="values where"):
        listing.sizes_checked(sizes, NX * NY * NZ).collect()
    ok = {r["ok"] for r in listing.sizes_checked(sizes, NX * NY * NZ, fail=False).collect()}
    assert ok == {0, 1}


def test_variable_directories_and_vectors(spark, tmp_path):
    base = cube(0)
    os.makedirs(tmp_path / "velocity")
    np.stack([base, base + 1, base + 2], axis=-1).astype("<f4").tofile(tmp_path / "velocity" / "cube_uvw.3")
    rows = rawgrid.read_raw_grid(spark, str(tmp_path), ["velocity"], (NX, NY, NZ), layout="var_dir", vectors=["velocity"]).toPandas()
    want = 1000 * rows.gz + 10 * rows.gy + rows.gx
    assert np.allclose(rows.velocity_x, want) and np.allclose(rows.velocity_z, want + 2) and set(rows.timestep) == {3}


def test_block_directories_swap_axes_and_use_the_origin(spark, tmp_path):
    x, z, y = np.meshgrid(range(2), range(16), range(16), indexing="ij")  # stored (X, Z, Y), x fastest
    data = (100 * z + 10 * x + y * 0.5).astype("<f4")
    os.makedirs(tmp_path / "5")
    data.ravel(order="F").tofile(tmp_path / "5" / "cube_enst.10")
    rows = rawgrid.read_raw_grid(spark, str(tmp_path), ["enstrophy"], (16, 16, 16), layout="block_dir", sizes=(2, 2, 2)).toPandas()
    assert set(rows.timestep) == {5} and set(rows.file_no) == {10}
    assert sorted(rows.gy.unique()) == [2, 3] and sorted(rows.gz.unique()) == [4, 5]  # 10 = 1 * 8 + 2
    assert np.allclose(rows.enstrophy, 100 * rows.gz + 10 * rows.gx + rows.gy * 0.5)


def test_times_from_names(spark):
    names = ["/d/u_28.240000", "/d/u_28.040000", "/d/v_28.040000", "/d/readme", "/d/u_1.5.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r[0] for r in listing.available_times(df).collect()] == [28.04, 28.24]


def test_formats_by_name(spark, raw):
    p = CurationParams(input_vars=("u",), output_vars=("p",), cluster_var=("pv",), nx=NX, ny=NY, nz=NZ, nxsl=4, nysl=3, nzsl=4, timesteps=(28.2400005, 9.0), pad=2)
    rows = formats.load(spark, "raw-grid", raw, p)
    assert [r[0] for r in rows.select("timestep").distinct().collect()] == [28.24]


def test_openfoam_times_share_tasks(spark, tmp_path):
    """Tasks are bounded by the cores, however many times there are, and all times are read."""
    assert openfoam.read_snapshots(spark, str(tmp_path), 10, 20_000).rdd.getNumPartitions() <= 32 * 8
    for t in range(1, 301):
        os.makedirs(tmp_path / str(t))
        for name, kind, value in (("p", "scalar", f"{t}.5"), ("U", "vector", f"(1 {t} 2)"), ("vorticity", "vector", f"(0 0 {-t})")):
            with gzip.open(tmp_path / str(t) / f"{name}.gz", "wb") as out:
                out.write(f"internalField nonuniform List<{kind}>\n2\n(\n{value}\n{value}\n)\n;\n".encode())
    rows = openfoam.read_snapshots(spark, str(tmp_path), 1, 300).toPandas()
    assert len(rows) == 600 and set(rows.timestep) == set(range(1, 301)) and set(rows.point_id) == {0, 1}
    assert (rows.p == rows.timestep + 0.5).all() and (rows.v == rows.timestep).all() and (rows.wz == -rows.timestep).all()


def test_openfoam(spark, tmp_path):
    def write(t, name, kind, lines):
        os.makedirs(tmp_path / str(t), exist_ok=True)
        text = f"FoamFile {{ }}\ninternalField nonuniform List<{kind}>\n{len(lines)}\n(\n" + "\n".join(lines) + "\n)\n;\nboundaryField { a { value uniform (0 0 0); } }\n"
        with gzip.open(tmp_path / str(t) / name, "wb") as out:
            out.write(text.encode())

    for t in (10, 20):
        write(t, "p.gz", "scalar", [f"{t + i}.5" for i in range(3)])
        write(t, "U.gz", "vector", [f"({i} {t} -1e-3)" for i in range(3)])
        write(t, "vorticity.gz", "vector", [f"(0 0 {t * i})" for i in range(3)])
    write(0, "C.gz", "vector", ["(0 1 2)", "(3 4 5)", "(6 7 8)"])
    rows = openfoam.project(openfoam.read_snapshots(spark, str(tmp_path), 10, 2), "wz", 3).toPandas().sort_values(["timestep", "point_id"])
    assert list(rows.target_wz) == [0, 10, 20, 0, 20, 40] and list(rows.v) == [10] * 3 + [20] * 3 and set(rows.w) == {-1e-3}
    assert openfoam.read_cells(spark, str(tmp_path)).toPandas().sort_values("point_id").x.tolist() == [0, 3, 6]
    with pytest.raises(ValueError):
        openfoam.project(rows, "wz", 4)


def test_npz_npy_and_axes(spark, tmp_path):
    data = np.arange(24.0).reshape(2, 3, 4)
    for v, shift in (("u", 0), ("p", 100)):
        np.savez(tmp_path / f"{v}_PVsample-nx2ny3nz4_nskip1_t0.500000.npz", datacube=data + shift)
    np.savez(tmp_path / "u_PVsample-nx2ny3nz4_nskip1_t0.700000.npz", datacube=data)
    with pytest.raises(Exception, match="not complete"):
        arrays.npz_snapshots(spark, str(tmp_path), ["u", "p"]).collect()
    rows = arrays.npz_snapshots(spark, str(tmp_path), ["u", "p"], skip_incomplete=True).toPandas()
    assert len(rows) == 24 and set(rows.timestep) == {0.5}
    assert (rows.u == rows.gx * 12 + rows.gy * 4 + rows.gz).all() and (rows.p == rows.u + 100).all()
    np.savez(tmp_path / "axes.npz", x=np.arange(2), y=np.arange(3), z=np.arange(4) / 4)
    axes = arrays.read_npz_axes(spark, str(tmp_path / "axes.npz")).toPandas()
    assert axes.groupby("axis").size().to_dict() == {"x": 2, "y": 3, "z": 4}
    np.save(tmp_path / "c.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert arrays.read_npy_cloud(spark, str(tmp_path)).toPandas().sort_values("point_id").cv.tolist() == [1.0, 3.0]


def test_csv_snapshots(spark, tmp_path):
    head = "X,Y,dudx,dudy,dvdx,dvdy,vortZ,TKE\n"
    (tmp_path / "cylinder_t0001.csv").write_text(head + "0,0,1,2,3,4,5,0\n1,0,1,2,3,4,6,-2.5\n")
    (tmp_path / "cylinder_t0012.csv").write_text(head + "0,0,1,2,3,4,7,1e-10\n")
    rows = tabular.read_csv_snapshots(spark, str(tmp_path)).toPandas().sort_values(["timestep", "X"])
    assert rows.timestep.tolist() == [1, 1, 12]
    assert np.allclose(rows.log_tke, np.log([1e-8, 2.5, 1e-8]))


def test_force_log(spark, tmp_path):
    lines = ["# Time forces(pressure viscous)"] + [f"{i} (({i} {2 * i} 0) (1 1 1))" for i in range(7)]
    (tmp_path / "forces.dat").write_text("\n".join(lines) + "\n")
    rows = sorted(tuple(r) for r in tabular.read_forces(spark, str(tmp_path / "forces.dat"), 3).collect())
    assert rows == [(0.0, 0.0), (3.0, 9.0), (6.0, 18.0)]


def test_energy_snapshots(spark, tmp_path):
    from cellsift.operators import energy

    def snap(node, phase, t, **c):
        full = {"timestamp": t, "timestamp_readable": "x", "hostname": "h", "phase": phase, **{k: 0.0 for k in energy.COUNTERS}, "Node": None, **c}
        (tmp_path / f"{node}_snapshot_{phase}.json").write_text(json.dumps(full, indent=2))

    snap("0", "start", 10.0, CPU=100.0, Mem=10.0)
    snap("0", "lap", 10.0, CPU=150.0, Mem=10.0, Accel0=5.0)
    snap("0", "end", 20.0, CPU=300.0, Mem=30.0, Accel0=50.0)
    snap("1", "start", 12.0, CPU=1.0, Accel3=None)
    snap("1", "end", 30.0, CPU=91.0, Accel1=9.0)
    snaps = tabular.read_energy_snapshots(spark, str(tmp_path))
    nodes = {r["node_id"]: r for r in energy.node_energy(snaps).collect()}
    assert nodes["1"]["cpu_joules"] == 90.0 and nodes["1"]["gpu_joules"] == 9.0 and nodes["1"]["joules"] == 99.0
    assert nodes["0"]["elapsed"] == 10.0
    steps = energy.intervals(snaps).toPandas()
    assert len(steps) == 3
    tied = steps[(steps.node_id == "0") & (steps.elapsed == 0)]
    assert tied.watts.isna().all()
    assert steps[steps.node_id == "1"].joules.iloc[0] == 99.0
    total = energy.job_energy(energy.node_energy(snaps)).first()
    assert total["elapsed"] == 20.0


def test_crops_read_few_bytes(tmp_path, monkeypatch):
    """Batches stay small for any plane, and a crop costs at most twice its bytes."""
    nx, ny, nz = 96, 40, 5
    data = np.arange(nx * ny * nz, dtype="<f4").reshape(nz, ny, nx)
    data.tofile(tmp_path / "u_1.000000")
    monkeypatch.setattr(rawgrid, "ROWS_PER_BATCH", 300)
    for offset, size in (((10, 5, 1), (32, 8, 3)), ((0, 0, 0), (96, 40, 5)), ((90, 39, 4), (6, 1, 1)), ((3, 0, 0), (60, 40, 2))):
        layout = rawgrid._layout(str(tmp_path), ["u"], (nx, ny, nz), {"offsets": offset, "sizes": size})
        file, seen = layout.open("u", str(tmp_path / "u_1.000000")), []
        for planes, rows, fast in layout.batches(layout.wanted("z"), layout.wanted("y"), layout.wanted("x")):
            assert len(planes) * len(rows) * len(fast) <= 300
            seen += layout.cells(file, "u", planes, rows, fast)[:, 0].tolist()
        box = data[offset[2] : offset[2] + size[2], offset[1] : offset[1] + size[1], offset[0] : offset[0] + size[0]]
        assert sorted(seen) == sorted(box.ravel().tolist())
        assert file.bytes_read <= 2 * box.nbytes


def test_large_planes_and_small_snapshots(spark, raw, monkeypatch):
    whole = sorted(map(tuple, rawgrid.read_raw_grid(spark, raw, ["u", "p"], (NX, NY, NZ), pad=2).collect()))
    read = lambda: rawgrid.RawGridReader(layout, layout.schema())
    layout = rawgrid._layout(raw, ["u", "p"], (NX, NY, NZ), {"pad": 2})
    assert len(read().partitions()) == 1  # three small snapshots together
    monkeypatch.setattr(rawgrid, "SLAB_BYTES", 150)
    monkeypatch.setattr(rawgrid, "PACK_BYTES", 0)
    monkeypatch.setattr(rawgrid, "ROWS_PER_BATCH", 7)
    parts = read().partitions()
    assert len(parts) == 3 * NZ * NY // 2
    batches = [b for p in parts for b in read().read(p)]
    assert max(b.num_rows for b in batches) <= 7
    assert sorted(tuple(r.values()) for b in batches for r in b.to_pylist()) == whole


def test_files_with_several_cubes(spark, tmp_path):
    """Four cubes a file, one after the other along x; a vector too."""
    n = 4  # a block of 4 cells along each axis, in a grid of 16
    for folder in ("all", "2"):
        os.makedirs(tmp_path / folder)
        for name, parts in (("enst", 1), ("uvw", 3)):
            cube, y, z, x = np.meshgrid(range(4), range(16), range(16), range(n), indexing="ij")  # stored y, z, x
            base = 1000.0 * cube + 100 * x + 10 * (y % 10) + (z % 10)
            np.stack([base + 0.25 * c for c in range(parts)], -1).astype("<f4").tofile(tmp_path / folder / f"cube_{name}.6")
    read = lambda **o: rawgrid.read_raw_grid(spark, str(tmp_path), ["enstrophy", "velocity"], (16, 16, 16), layout="block_dir", vectors=["velocity"], blocks=4, sizes=(4, 4, 4), cubes=4, **o)
    rows = read().toPandas()
    assert len(rows) == 5 * 64 and set(rows.gy) == {4, 5, 6, 7} and set(rows.gz) == {8, 9, 10, 11}  # 6 = 1 * 4 + 2
    cube = rows.timestep
    local = rows.gx % 4
    assert np.allclose(rows.enstrophy, 1000 * cube + 100 * local + 10 * (rows.gy % 10) + rows.gz % 10)
    assert np.allclose(rows.velocity_z, rows.enstrophy + 0.5)
    at = rows.groupby("timestep").gx.apply(lambda g: sorted(set(g))).to_dict()
    assert at == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [0, 1, 2, 3, 8, 9, 10, 11], 3: [12, 13, 14, 15]}
    with pytest.raises(Exception, match="bytes where the grid needs"):
        rawgrid.read_raw_grid(spark, str(tmp_path), ["enstrophy"], (16, 16, 16), layout="block_dir", blocks=4, sizes=(4, 4, 4)).count()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_arrays_in_stretches(spark, tmp_path, monkeypatch, save):
    """Stretches of stored arrays, streams of compressed ones, both orders of axes."""
    monkeypatch.setattr(arrays, "STRETCH", 50)
    data = np.arange(5 * 6 * 7, dtype="<f4").reshape(5, 6, 7)
    for t, order in ((0.5, "C"), (1.5, "F")):
        for v, shift in (("u", 0), ("p", 1000)):
            save(tmp_path / f"{v}_x_t{t:.6f}.npz", datacube=np.asarray(data + shift, order=order))
    df = arrays.npz_snapshots(spark, str(tmp_path), ["u", "p"])
    rows = df.toPandas()
    assert len(rows) == 2 * data.size and (rows.u == rows.point_id).all() and (rows.p == rows.u + 1000).all()
    assert (rows.point_id == (rows.gx * 6 + rows.gy) * 7 + rows.gz).all()
    assert df.rdd.getNumPartitions() >= (5 if save is np.savez else 2)
    cloud = np.arange(600.0).reshape(200, 3)
    np.save(tmp_path / "a.npy", cloud)
    np.save(tmp_path / "b.npy", np.asfortranarray(cloud))
    back = arrays.read_npy_cloud(spark, str(tmp_path)).toPandas()
    assert len(back) == 400 and (back.x0 == 3 * back.point_id).all() and (back.x1 == back.x0 + 1).all()


def test_field_streams(tmp_path, monkeypatch):
    """Lists cut at any place, on one line or on many, plain and compressed."""
    rng = np.random.default_rng(1)
    for width, kind in ((1, "scalar"), (3, "vector")):
        values = rng.normal(size=(257, width)).round(6)
        lines = [("(%s)" if width == 3 else "%s") % " ".join(map(repr, map(float, v))) for v in values]
        for i, (joint, end) in enumerate((("\n", "\n)\n;\nboundaryField { a { value uniform (1 2 3); } }\n"), (" ", ");\n"))):
            text = f"FoamFile {{ format ascii; }}\ninternalField nonuniform List<{kind}>\n{len(lines)}\n({joint}{joint.join(lines)}{end}".encode()
            for name, body in ((f"{kind}{i}.gz", gzip.compress(text[:999]) + gzip.compress(text[999:])), (f"{kind}{i}", text)):
                (tmp_path / name).write_bytes(body)
                for chunk in (7, 64, 1 << 20):
                    monkeypatch.setattr(openfoam, "CHUNK", chunk)
                    found = list(openfoam.field_values(str(tmp_path / name)))
                    assert np.array_equal(np.concatenate(found), values)
                    assert chunk > 64 or max(f.size for f in found) <= chunk
        (tmp_path / "short").write_bytes(text.replace(b"\n257\n", b"\n258\n"))
        with pytest.raises(ValueError, match="announced"):
            list(openfoam.field_values(str(tmp_path / "short")))
