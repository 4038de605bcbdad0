"""Compares a query with its DuckDB SQL on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(pdf) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return [tuple(None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v for v in r) for r in pdf.itertuples(index=False)]


def differences(spark, sf_dir: str, query, sql: str) -> str:
    ours, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir).execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = (sorted(map(repr, rows(x))) for x in (ours, theirs))
    if a == b:
        return ""
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} and {len(b)} rows; {only}"


def data(sf: str) -> str:
    return os.path.join(os.environ.get("TESTDATA", "/root/testdata"), sf)
