"""CSV snapshots: one timestamped folder per export, one file per task."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DataType, TimestampNTZType, TimestampType

from millrace.functions.names import safe_name
from millrace.sources.csv import DIALECT


def snapshot_path(base: str, table: str, at: datetime) -> str:
    name = safe_name(table)
    return f"{base.rstrip('/')}/{name}/{name}_{at:%Y%m%d%H%M%S}"


def export_csv(df: DataFrame, base: str, table: str, at: datetime) -> str:
    """Write ``df`` with a header, NULL as an empty cell, and return the folder.

    Times keep their fraction and booleans read ``True``/``False``. The rows are never drawn
    together into one file.
    """
    path = snapshot_path(base, table, at)
    text = df.select(*[_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    text.write.mode("overwrite").options(
        **{k: v for k, v in DIALECT.items() if k != "mode"},
        header=True, nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)
    return path


def _cell(value: Column, data_type: DataType) -> Column:
    if isinstance(data_type, BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(data_type, (TimestampType, TimestampNTZType)):
        return value.cast("string")
    return value
