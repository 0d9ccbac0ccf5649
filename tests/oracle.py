"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def differ(spark, query, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    ours = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        one, two = [x for x in ours if x not in theirs[:2000]][:2], [x for x in theirs if x not in ours[:2000]][:2]
        return f"{len(ours)} and {len(theirs)} rows; only ours {one}, only SQL {two}"
    return ""
