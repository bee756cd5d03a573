"""Run a registered query and its SQL, and compare the rows regardless of order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("", "null")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return ("n", f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return ("l", str([cell(x) for x in value]))
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    result = duck(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, result.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
    return len(a)
