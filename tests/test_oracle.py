"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def rows(df):
    def cell(x):
        if pd.isna(x):
            return ""
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_all(spark):
    from logspark.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in ORACLE_SQL.items():
        assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(sql).df()), name
