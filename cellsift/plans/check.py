"""Run queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sf: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    return names, kinds, result.fetchall()


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v.asDict().values())
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return v


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, sf: str, fn, sql: str | None) -> tuple[bool, str]:
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL"
    names, kinds, want = oracle_rows(sf, sql)
    left_names, left = _sorted_rows(df.columns, got)
    right_names, right = _sorted_rows(names, want)
    if left_names != right_names:
        return False, f"columns {left_names} != {right_names}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck = dict(zip(names, kinds))
    note = ", ".join(f"{n}:{types[n]}/{duck[n]}" for n in left_names if (types[n], duck[n]) not in SAME)
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(left)} rows differ, first {bad[0]}"
    return not note and bool(left), f"{len(left)} rows {('TYPES ' + note) if note else ''}"


SAME = {("bigint", "BIGINT"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"), ("int", "INTEGER"), ("array<double>", "DOUBLE[]")}


def main(argv: list[str]) -> int:
    from cellsift.plans import catalog
    from cellsift.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    catalog.load_all()
    spark = build_session(8)
    failed = 0
    for name, fn in catalog.QUERIES.items():
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, sf, fn, catalog.ORACLE.get(name))
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
