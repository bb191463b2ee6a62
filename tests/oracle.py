"""A query's rows beside those of its SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb


def _plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*' if p.is_dir() else ''}'")
    return con


def both(df, sql: str, sf_dir: str) -> tuple[list, list]:
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    cols = sorted(names)
    assert sorted(df.columns) == cols
    order = [names.index(c) for c in cols]
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in found.fetchall())
    ours = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    return ours, theirs
