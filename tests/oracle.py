"""Compares a query with its SQL on DuckDB."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def rows(df):
    """Rows as sorted texts, columns by name."""
    cols = sorted(df.columns)
    return cols, sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


def expected(sql, sf_dir=DATA, **tables):
    """What the SQL gives on the given tables; keyword tables (pandas) replace files."""
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[:-8]
        if name not in tables:
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    for name, pdf in tables.items():
        c.register(name, pdf)
    return rows(c.sql(sql).df())
