"""Compare a query's rows with those of its DuckDB SQL, as sorted texts."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def _text(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in rows)


def compare(spark, db, query, sql: str, sf_dir: str) -> tuple[list, list, list, list]:
    df = query(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = db.execute(sql)
    want_cols, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    return cols, want_cols, got, want
