"""Run a query on Spark and its SQL on DuckDB and compare all rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat(sep=" ")
    return value if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, v or "") for v in r))


def spark_kind(data_type: str) -> str:
    return {"timestamp_ntz": "TIMESTAMP", "int": "INTEGER", "string": "VARCHAR"}.get(data_type, data_type.upper())


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    theirs_columns, theirs = rows_of(names, result.fetchall())
    ours_columns, ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if ours_columns != theirs_columns:
        return f"columns {ours_columns} != {theirs_columns}"
    types = {f.name: spark_kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    if types != kinds:
        return "types " + str({c: (types[c], kinds[c]) for c in types if types[c] != kinds[c]})
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference\n  spark  {dict(zip(ours_columns, a))}\n  duckdb {dict(zip(ours_columns, b))}"
    return None
