"""Pieces of the SQL that states what the queries must return."""

from __future__ import annotations

from collections.abc import Sequence


def key(parts: Sequence[str], seed: str | int) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return (
        f"(CAST((('0x' || substr(md5(concat_ws(':', {text}, '{seed}')), 1, 13))::BIGINT + 1) AS DOUBLE)"
        " / CAST(4503599627370497 AS DOUBLE))"
    )


def race(parts: Sequence[str], seed: str | int, weight: str | None = None) -> str:
    time = f"(-ln({key(parts, seed)}))"
    return time if weight is None else f"({time} / {weight})"


def bin_of(value: str, lo: str, hi: str, bins: int) -> str:
    """Bin with the flat-range rule and the closed last edge."""
    low = f"(CASE WHEN {lo} = {hi} THEN {lo} - 0.5 ELSE {lo} END)"
    high = f"(CASE WHEN {lo} = {hi} THEN {hi} + 0.5 ELSE {hi} END)"
    return f"CAST(greatest(least(floor(({value} - {low}) / ({high} - {low}) * {bins}), {bins - 1}), 0) AS BIGINT)"


def pooled(view: str, cols: Sequence[str], name: str = "pooled", keep: str = "timestep") -> str:
    """CTE with one row per value of ``cols``."""
    parts = " UNION ALL ".join(f"SELECT {keep}, {c} AS value FROM {view}" for c in cols)
    return f"{name} AS ({parts})"


def midpoints(view: str, cols: Sequence[str], k: int, name: str = "centres") -> str:
    """CTE with columns c{i}_{axis} of fixed centres per timestep."""
    each = ", ".join(
        f"lo{a} + (hi{a} - lo{a}) * CAST({(i + 0.5) / k!r} AS DOUBLE) AS c{i}_{a}" for i in range(k) for a in range(len(cols))
    )
    ranges = ", ".join(f"min({c}) AS lo{a}, max({c}) AS hi{a}" for a, c in enumerate(cols))
    return f"{name} AS (SELECT timestep, {each} FROM (SELECT timestep, {ranges} FROM {view} GROUP BY timestep))"


def labelled(view: str, cols: Sequence[str], k: int, name: str = "labelled", centres: str = "centres") -> str:
    """CTE: rows of ``view`` with the nearest centre, ties to the lowest."""
    gaps = [
        " + ".join(f"({c} - c{i}_{a}) * ({c} - c{i}_{a})" for a, c in enumerate(cols)) for i in range(k)
    ]
    return (
        f"{name} AS (SELECT * EXCLUDE (gaps), CAST(list_position(gaps, list_min(gaps)) - 1 AS BIGINT) AS label FROM "
        f"(SELECT v.*, [{', '.join(gaps)}] AS gaps FROM {view} v JOIN {centres} USING (timestep)))"
    )


def moved(rows: str, cols: Sequence[str], k: int, name: str, old: str) -> str:
    """CTE: centres after one pass over labelled rows."""
    each = ", ".join(
        f"coalesce(avg(CASE WHEN label = {i} THEN {c} END), any_value(o.c{i}_{a})) AS c{i}_{a}"
        for i in range(k)
        for a, c in enumerate(cols)
    )
    return f"{name} AS (SELECT r.timestep, {each} FROM (SELECT timestep, label, {', '.join(cols)} FROM {rows}) r JOIN {old} o USING (timestep) GROUP BY r.timestep)"


def cluster_hist(rows: str, cols: Sequence[str], k: int, bins: int, name: str = "hist") -> str:
    """CTEs: counts per (timestep, label, bin), zeros included."""
    values = " UNION ALL ".join(f"SELECT timestep, label, {c} AS value FROM {rows}" for c in cols)
    return f"""lv AS ({values}),
rng AS (SELECT timestep, min(value) AS lo, max(value) AS hi FROM lv GROUP BY timestep),
cnts AS (SELECT timestep, label, {bin_of('value', 'lo', 'hi', bins)} AS bin, count(*) AS cnt FROM lv JOIN rng USING (timestep) GROUP BY ALL),
{name} AS (SELECT t.timestep, l.label, b.bin, coalesce(c.cnt, 0) AS cnt FROM (SELECT DISTINCT timestep FROM lv) t
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS label FROM range({k})) l CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range({bins})) b
  LEFT JOIN cnts c ON c.timestep = t.timestep AND c.label = l.label AND c.bin = b.bin)"""


def probabilities(hist: str = "hist", name: str = "dist") -> str:
    """CTEs: probability plus epsilon, and its normalised form p."""
    return f"""raw_{name} AS (SELECT *, CASE WHEN sum(cnt) OVER w > 0 THEN cnt / sum(cnt) OVER w ELSE 0 END + 1e-10::DOUBLE AS q
  FROM {hist} WINDOW w AS (PARTITION BY timestep, label)),
{name} AS (SELECT timestep, label, bin, cnt, q, q / sum(q) OVER (PARTITION BY timestep, label) AS p FROM raw_{name})"""


def kl(dist: str = "dist", name: str = "kl") -> str:
    return f"""{name} AS (SELECT a.timestep, a.label AS i, b.label AS j, sum(a.p * ln(a.p / b.p)) AS kl
  FROM {dist} a JOIN {dist} b ON a.timestep = b.timestep AND a.bin = b.bin GROUP BY ALL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
