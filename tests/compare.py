"""Runs a registered query and its SQL side by side."""

import os

import duckdb
import pandas as pd

from driftline.sources.catalog import TABLES


def engine(root):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{root}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def show(v):
        if isinstance(v, float):
            return "None" if v != v else repr(round(v, 9))
        return "None" if v is None or v is pd.NaT or v is pd.NA else str(v)

    return sorted(str([show(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))
