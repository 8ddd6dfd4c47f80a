"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def oracle_rows(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    types = [str(c[1]) for c in cur.description]
    rows = cur.fetchall()
    con.close()
    return names, types, rows


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql, folder):
    """None when equal, otherwise a short report."""
    names, types, want = oracle_rows(sql, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = [tuple(r) for r in df.collect()]
    a, b = bag(df.columns, got), bag(names, want)
    if a == b:
        kinds = dict(zip(names, types))
        odd = {n: (t, kinds[n]) for n, t in df.dtypes if not same_type(t, kinds[n])}
        return f"types {odd}" if odd else None
    extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{len(got)} rows != {len(want)}; only here {extra}; only there {missing}"


SAME = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def same_type(spark_type: str, duck_type: str) -> bool:
    return SAME.get(spark_type) == duck_type
