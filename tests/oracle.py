"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def kind(v):
    return {"int": "int", "float": "double", "str": "text", "bool": "bool"}.get(type(v).__name__, type(v).__name__)


def compare(df, con, sql: str) -> list[str]:
    """Differences, empty when the two sides agree."""
    names = sorted(df.columns)
    got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return [f"columns {names} != {sorted(cols)}"]
    at = [cols.index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    for i, n in enumerate(names):
        a, b = {kind(r[i]) for r in got}, {kind(r[i]) for r in want}
        if a != b:
            out.append(f"types of {n}: {a} != {b}")
    gs, ws = sorted(map(repr, got)), sorted(map(repr, want))
    if gs != ws:
        only = set(gs) - set(ws), set(ws) - set(gs)
        out.append(f"ours only {len(only[0])}: {[x[:300] for x in sorted(only[0])[:3]]}")
        out.append(f"sql only {len(only[1])}: {[x[:300] for x in sorted(only[1])[:3]]}")
    return out
