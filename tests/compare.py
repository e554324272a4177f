"""Run a registered query and its reference SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when nothing does."""
    types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    mine = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = {d[0]: str(d[1]) for d in cursor.description}
    theirs = _rows(names, cursor.fetchall())
    found = []
    if sorted(df.columns) != sorted(names):
        found.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    found += [f"type of {c}: {types.get(c)} != {wanted[c]}" for c in wanted if types.get(c) != wanted[c]]
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows != {len(theirs)} rows")
    if mine != theirs:
        only_mine, only_theirs = sorted(set(mine) - set(theirs)), sorted(set(theirs) - set(mine))
        found.append(f"values: {len(only_mine)} only here {[tuple(c[:60] for c in r) for r in only_mine[:2]]}; "
                     f"{len(only_theirs)} only in SQL {[tuple(c[:60] for c in r) for r in only_theirs[:2]]}")
    return found
