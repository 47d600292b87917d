"""Spark's rows against DuckDB's for one registered query."""

from __future__ import annotations

import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(names: list[str], rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if both sides have the same columns and rows."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if mine != theirs:
        odd = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b][:2]
        return f"{name}: {len(mine)} and {len(theirs)} rows; first differences {odd}"
    return ""
