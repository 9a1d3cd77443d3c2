"""Run a query on Spark and its SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from contract.views import TABLES


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in row) for row in df.select(*names).collect())


def duck_rows(sf_dir: str, sql: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    types = {d[0]: str(d[1]) for d in cursor.description}
    return names, types, Counter(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())


# Engine type names that stand for the same thing.
SAME = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def differences(df, sf_dir: str, sql: str) -> list[str]:
    spark_names, left = spark_rows(df)
    duck_names, types, right = duck_rows(sf_dir, sql)
    if spark_names != duck_names:
        return [f"columns {spark_names} != {duck_names}"]
    out = []
    for name, kind in df.dtypes:
        if SAME.get(kind, kind) != types[name]:
            out.append(f"type of {name}: {kind} != {types[name]}")
    if left != right:
        out.append(f"rows {sum(left.values())} vs {sum(right.values())}")
        out += [f"only spark {n}x {r}" for r, n in list((left - right).items())[:3]]
        out += [f"only duckdb {n}x {r}" for r, n in list((right - left).items())[:3]]
    return out
