"""Compare a query with its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v  # whole numbers beside nulls come as floats

    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


def same(got, con, sql: str) -> None:
    expected = con.execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
