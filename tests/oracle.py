"""Side-by-side run of a query and its SQL in DuckDB."""

from __future__ import annotations

import glob
import os
import time

import duckdb

TOLERANCE = 0.0


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


FAMILY = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return "NULL" if v is None else str(v)


def compare(spark, db, folder: str, run, sql: str) -> dict:
    started = time.time()
    df = run(spark, folder)
    names = sorted(df.columns)
    ours = sorted(tuple(_plain(x) for x in row) for row in df.select(
        *[f"`{n}`" for n in names]).collect())
    seconds = time.time() - started
    started = time.time()
    rel = db.sql(sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    quoted = ", ".join(f'"{n}"' for n in names)
    problems = []
    if sorted(rel.columns) != names:
        return {"problems": [f"columns {names} vs {sorted(rel.columns)}"], "rows": len(ours),
                "seconds": seconds, "sql_seconds": 0}
    theirs = sorted(tuple(_plain(x) for x in row)
                    for row in db.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    sql_seconds = time.time() - started
    for name, kind in df.dtypes:
        if FAMILY.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} vs {len(theirs)}")
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if differing:
        problems.append(f"{len(differing)} rows differ, first {differing[0]}")
    return {"problems": problems, "rows": len(ours), "seconds": seconds,
            "sql_seconds": sql_seconds}
