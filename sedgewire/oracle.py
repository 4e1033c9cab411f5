"""Comparing queries with their SQL on DuckDB, as the driver does."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return con


def difference(frame, con, sql: str) -> str:
    """Empty if names and rows agree, whatever their order."""
    want = con.sql(sql)
    names = sorted(want.columns)
    if sorted(frame.columns) != names:
        return f"columns {sorted(frame.columns)} and {names}"
    plain = lambda v: [plain(x) for x in v] if isinstance(v, list | tuple) else round(v, 9) if isinstance(v, float) else v
    a = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    at = [want.columns.index(c) for c in names]
    b = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    return "" if a == b else f"{len(a)} and {len(b)} rows; first differences {[(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]}"
