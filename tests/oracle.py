"""Compare a registered query with its SQL, as an unordered set of rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0  # exact: the driver compares hashes of values
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def same(df, sql: str, sf_dir: str) -> None:
    cols = sorted(df.columns)
    rel = duck(sf_dir).execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols, (sorted(names), cols)
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (cols, a, b)
