"""Comparing a query's rows with DuckDB's."""

from pathlib import Path

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(str(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()))


def oracle_rows(sql, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.sql(sql)
    names = sorted(got.columns)
    at = [got.columns.index(n) for n in names]
    return names, sorted(tuple(str(r[i]) for i in at) for r in got.fetchall())
