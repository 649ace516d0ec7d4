"""Parameters of a curation job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum


class TargetKind(Enum):
    """What the target of a sample is."""

    GLOBAL = "global"  # one row per timestep
    LOCAL = "local"  # the sampled points
    FULL = "full"  # every point


# Names a user may give for the two selection stages, vector
# variables, the input formats, the scalers and the targets.
BOX_METHODS = ("uniform", "maxent", "random")
POINT_METHODS = ("maxent", "random", "full", "uips", "lhs", "stratified")
SCALERS = ("StandardScaler", "MinMaxScaler", "PowerTransformer", "None")
STARTS = ("seeded", "parallel", "fixed")
VECTORS = ("velocity",)
FORMATS = ("openfoam", "csv", "npz", "raw-grid", "cube-dirs", "cube-blocks")
TARGETS = ("drag", "p", "p_full", "wz", "tke")


@dataclass(frozen=True)
class CurationParams:
    """Settings of box selection, point sampling and table preparation.

    Explicit arguments are the only source of values: there is no file that can
    silently win over them.
    """

    hypercubes: str = "uniform"
    num_hypercubes: int | None = 1
    method: str = "maxent"
    num_samples: int = 100
    per_cube: bool = False
    num_clusters: int = 10
    kmeans_rounds: int = 10
    starts: str = "seeded"
    cluster_var: tuple[str, ...] = ("pv",)
    input_vars: tuple[str, ...] = ("u", "v", "w", "r")
    output_vars: tuple[str, ...] = ("p", "pv")
    target: str = "wz"
    nx: int = 514
    ny: int = 512
    nz: int = 256
    nxsl: int = 128
    nysl: int = 128
    nzsl: int = 128
    nxskip: int = 1
    nyskip: int = 1
    nzskip: int = 1
    nxoffset: int = 0
    nyoffset: int = 0
    nzoffset: int = 0
    pad: int = 2
    cubes_per_file: int = 1
    gravity: str = "z"
    Lh: float = 1.0
    Lv: float = 0.5
    dims: int = 2
    window: int = 2
    overlap: int = 1
    timesteps: tuple[float, ...] | None = None
    write_interval: int = 100
    num_timesteps: int = 100
    test_frac: float = 0.1
    shuffle: bool = False
    xscaler: str = "MinMaxScaler"
    yscaler: str = "StandardScaler"
    bins: int = 100
    box_bins: int = 10
    point_bins: int = 50
    phase_bins: int = 10
    seed: int = 0
    group_cols: tuple[str, ...] = field(default=("timestep",))

    def __post_init__(self) -> None:
        for value, allowed, name in (
            (self.hypercubes, BOX_METHODS, "hypercubes"),
            (self.method, POINT_METHODS, "method"),
            (self.starts, STARTS, "starts"),
            (self.xscaler, SCALERS, "xscaler"),
            (self.yscaler, SCALERS, "yscaler"),
        ):
            if value not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {value!r}")
        if not 0 <= self.overlap < self.window and self.window > 1:
            raise ValueError(f"overlap ({self.overlap}) must be >= 0 and < window ({self.window})")
        if self.method == "full" and self.target_kind is TargetKind.LOCAL:
            raise ValueError("a full input field cannot have a sampled target")

    @property
    def box(self) -> tuple[int, int, int]:
        return self.nxsl, self.nysl, self.nzsl

    @property
    def grid(self) -> tuple[int, int, int]:
        return self.nx, self.ny, self.nz

    @property
    def target_kind(self) -> TargetKind:
        if self.target == "drag":
            return TargetKind.GLOBAL
        if self.target == "p_full" or self.method == "full":
            return TargetKind.FULL
        return TargetKind.LOCAL

    @property
    def variables(self) -> list[str]:
        """Every variable that is read, once."""
        return list(dict.fromkeys([*self.cluster_var, *self.input_vars, *self.output_vars]))

    def by_component(self, vectors: Sequence[str]) -> CurationParams:
        """The same parameters with the columns of vector variables in place of their names."""
        each = lambda names: tuple(c for v in names for c in ([f"{v}_{a}" for a in "xyz"] if v in vectors else [v]))
        return replace(self, cluster_var=each(self.cluster_var), input_vars=each(self.input_vars), output_vars=each(self.output_vars))

    @property
    def samples_per_window(self) -> int:
        """Points kept per box: the box volume when every point is kept."""
        if self.method == "full":
            return self.nxsl * self.nysl * self.nzsl
        return self.num_samples
