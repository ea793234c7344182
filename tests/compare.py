"""Holds a query's rows against its DuckDB oracle."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(sql).df()


def _cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (bool, str)):
        return x
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 7) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted(repr(tuple(_cell(x) for x in r)) for r in df[cols].itertuples(index=False, name=None))


def same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)
