"""Compares a query with its SQL on the same tables: names, kinds of columns and values."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """What differs, or an empty text."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    if names != sorted(want.columns):
        return f"columns {got.columns} and {want.columns}"
    kinds = {n: str(k) for n, k in zip(want.columns, want.types)}
    odd = [(n, k, kinds[n]) for n, k in got.dtypes if KINDS.get(k) != kinds[n]]
    at = [want.columns.index(n) for n in names]
    a = Counter(tuple(plain(r[n]) for n in names) for r in got.collect())
    b = Counter(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    out = f"kinds {odd} " if odd else ""
    if a != b:
        out += f"rows {sum(a.values())} and {sum(b.values())}; only here {list((a - b).items())[:2]}, only there {list((b - a).items())[:2]}"
    return out
