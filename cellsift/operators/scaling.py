"""Scalers fitted on the training part and applied to both parts.

A fit is a small table with one row per column; it is applied as plain column
arithmetic, so the big table is neither joined nor shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from numpy.polynomial import Chebyshev
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsift.params import SCALERS


@dataclass(frozen=True)
class FittedScaler:
    """Constants of a fitted scaler, a few numbers per column."""

    kind: str
    constants: dict[str, tuple[float, ...]]

    def column(self, name: str) -> Column:
        return _apply(self.kind, F.col(name), self.constants[name])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.column(name) for name in self.constants})


def _apply(kind: str, x: Column, c: tuple[float, ...]) -> Column:
    if kind == "None":
        return x
    if kind == "StandardScaler":
        mean, dev = c
        return (x - F.lit(mean)) / F.lit(dev if dev else 1.0)
    if kind == "MinMaxScaler":
        low, high = c
        return (x - F.lit(low)) / F.lit((high - low) or 1.0)
    power, mean, dev = c
    return (yeo_johnson(x, power) - F.lit(mean)) / F.lit(dev if dev else 1.0)


def yeo_johnson(x: Column, power: float) -> Column:
    """Yeo-Johnson transform with a given power."""
    up = F.log1p(x) if abs(power) < 1e-12 else (F.pow(x + 1, F.lit(power)) - 1) / F.lit(power)
    rest = 2.0 - power
    down = -F.log1p(-x) if abs(rest) < 1e-12 else -(F.pow(1 - x, F.lit(rest)) - 1) / F.lit(rest)
    return F.when(x >= 0, up).otherwise(down)


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """Limits, mean and population deviation of every column, in one scan."""
    kinds = {"lo": F.min, "hi": F.max, "mean": F.avg, "dev": F.stddev_pop}
    row = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in kinds.items()]).first()
    return {c: {n: row[f"{n}_{c}"] for n in kinds} for c in cols}


def from_moments(kind: str, cols: Sequence[str], known: dict[str, dict[str, float]]) -> FittedScaler:
    """A scaler that needs no more than the moments: standard (a zero deviation
    scales by one), min-max (a constant column becomes zero), or none."""
    names = {"StandardScaler": ("mean", "dev"), "MinMaxScaler": ("lo", "hi"), "None": ()}[kind]
    return FittedScaler(kind, {c: tuple(known[c][n] for n in names) for c in cols})


def power_moments(df: DataFrame, col: str, powers: Sequence[float]) -> DataFrame:
    """Log-likelihood of each candidate power: one aggregation for all."""
    x = F.col(col)
    jacobian = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    spreads = [F.var_pop(yeo_johnson(x, p)).alias(f"v{i}") for i, p in enumerate(powers)]
    one = df.agg(F.count(x).alias("n"), jacobian.alias("j"), *spreads)
    entries = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("power"),
                (-F.col("n") / 2 * F.log(F.col(f"v{i}")) + F.lit(float(p) - 1) * F.col("j")).alias("likelihood"),
            )
            for i, p in enumerate(powers)
        ]
    )
    return one.select(F.explode(entries).alias("e")).select("e.power", "e.likelihood")


def _likelihoods(df: DataFrame, powers: dict[str, list[float]]) -> dict[str, list[float]]:
    """Log-likelihood per row of the candidate powers of all columns, in one scan."""
    wide = []
    for c, candidates in powers.items():
        x = F.col(c)
        wide += [F.count(x).alias(f"n_{c}"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"j_{c}"), (F.min(x) < F.max(x)).alias(f"differ_{c}")]
        wide += [F.var_pop(yeo_johnson(x, p)).alias(f"v{i}_{c}") for i, p in enumerate(candidates)]
    row = df.agg(*wide).first()
    out = {}
    for c, candidates in powers.items():
        spread = [row[f"v{i}_{c}"] for i in range(len(candidates))]
        out[c] = [
            -math.log(v) / 2 + (p - 1) * row[f"j_{c}"] / row[f"n_{c}"] if row[f"differ_{c}"] and 0 < v < math.inf else -math.inf
            for v, p in zip(spread, candidates)
        ]
    return out


#: Candidate powers of one scan: where the polynomial through them all is nearly the best one.
NODES = 13


def _peak(at: np.ndarray, values: np.ndarray, low: float, high: float) -> float:
    """Where in [low, high] the polynomial through the values is largest."""
    curve = Chebyshev.fit(at, values, len(at) - 1, domain=[at[0], at[-1]])
    turns = [r.real for r in curve.deriv().roots() if abs(r.imag) < 1e-9 and low < r.real < high]
    return max([low, high, *turns], key=curve)


def fit_power(df: DataFrame, cols: Sequence[str], low: float = -4.0, high: float = 6.0, tolerance: float = 1e-6) -> FittedScaler:
    """Yeo-Johnson power of largest likelihood, then standardised.

    A scan takes the likelihood of 13 candidates for every column, at Chebyshev points
    of a range. The likelihood is smooth in the power, so the polynomial through them has
    its peak where the likelihood has. Once the polynomial through every second one agrees on
    the peak to ``tolerance``, it stands; else the next scan takes a range around it, between
    the best candidate's neighbours. Mostly three scans, then one for mean and
    deviation. A best candidate at the edge of the first range moves the range on. A column
    of equal or only missing values keeps power 1.
    """
    place = -np.cos(np.pi * np.arange(NODES) / (NODES - 1))
    spans = {c: ((low + high) / 2, (high - low) / 2) for c in cols}
    best = dict.fromkeys(cols, 1.0)
    while spans:
        powers = {c: (mid + half * place).tolist() for c, (mid, half) in spans.items()}
        for c, found in _likelihoods(df, powers).items():
            at, half = np.array(powers[c]), spans.pop(c)[1]
            top = int(np.argmax(found))
            if found[top] == -math.inf:
                continue
            best[c] = float(at[top])
            first = half >= (high - low) / 2
            if first and top in (0, NODES - 1) and abs(best[c]) < 4 * max(abs(low), abs(high)):
                spans[c] = (best[c], half)
                continue
            left, right = at[max(top - 1, 0)], at[min(top + 1, NODES - 1)]
            smooth = np.array(found) - found[top]
            if not np.isfinite(smooth).all():
                spans[c] = ((left + right) / 2, (right - left) / 2)
                continue
            best[c] = _peak(at, smooth, left, right)
            off = abs(best[c] - _peak(at[::2], smooth[::2], left, right))
            if off > tolerance and right - left > tolerance:
                reach = max(3 * off, half / 100)
                left, right = max(left, best[c] - reach), min(right, best[c] + reach)
                spans[c] = ((left + right) / 2, (right - left) / 2)
    shaped = df.select(*[yeo_johnson(F.col(c), best[c]).alias(c) for c in cols])
    known = moments(shaped, cols)
    return FittedScaler("PowerTransformer", {c: (best[c], known[c]["mean"], known[c]["dev"]) for c in cols})


def fit(kind: str, df: DataFrame, cols: Sequence[str]) -> FittedScaler:
    return fit_together(df, [(kind, cols)])[0]


def fit_together(df: DataFrame, wanted: Sequence[tuple[str, Sequence[str]]]) -> list[FittedScaler]:
    """Several scalers from one scan; a power transform adds its passes."""
    for kind, _ in wanted:
        if kind not in SCALERS:
            raise ValueError(f"unknown scaler {kind!r}")
    simple = list(dict.fromkeys(c for kind, cols in wanted if kind in ("StandardScaler", "MinMaxScaler") for c in cols))
    known = moments(df, simple) if simple else {}
    return [fit_power(df, cols) if kind == "PowerTransformer" else from_moments(kind, cols, known) for kind, cols in wanted]


def slot_columns(packed: DataFrame, channel: str, slots: int) -> DataFrame:
    """Split a channel's array into one column per sample slot, for users who
    scale every slot by itself."""
    others = [c for c in packed.columns if c != channel]
    return packed.select(*others, *[F.col(channel)[i].alias(f"{channel}_{i}") for i in range(slots)])
