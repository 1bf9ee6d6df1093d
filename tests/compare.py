"""Run a query on Spark and its twin on DuckDB over the same files and compare them cell by cell."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else "nan") for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Differences found, empty if there are none."""
    names = sorted(df.columns)
    left = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    found = con.sql(sql)
    if sorted(found.columns) != names:
        return [f"columns {names} against {sorted(found.columns)}"]
    problems = []
    types = dict(zip(found.columns, map(str, found.types)))
    for f in df.schema:
        want = SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if types[f.name] != want:
            problems.append(f"type of {f.name}: {want} against {types[f.name]}")
    quoted = ", ".join(f'"{n}"' for n in names)
    right = sorted((tuple(r) for r in con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()), key=_key)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows against {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        cells = [(n, x, y) for n, x, y in zip(names, *bad[0]) if x != y]
        problems.append(f"{len(bad)} of {len(left)} rows differ, first in {cells[:6]}")
    return problems
