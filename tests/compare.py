"""Run a query on Spark and its SQL on DuckDB, and compare the results as sets of rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


_KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs: names, types, row counts, or the first rows found on one side only."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = dict(zip(names, (str(d[1]) for d in found.description)))
    expected = found.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} but SQL has {sorted(names)}"]
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != kinds[name].upper():
            problems.append(f"{name} is {kind} but {kinds[name]} in SQL")
    order = sorted(names)
    ours = sorted(repr(tuple(row[n] for n in order)) for row in df.collect())
    place = [names.index(n) for n in order]
    theirs = sorted(repr(tuple(row[i] for i in place)) for row in expected)
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} rows but {len(theirs)} in SQL")
    if ours != theirs:
        mine, other = set(ours), set(theirs)
        problems.append(f"only here {sorted(mine - other)[:3]}, only in SQL {sorted(other - mine)[:3]}")
    return problems
