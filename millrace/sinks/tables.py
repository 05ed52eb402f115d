"""Raw, clean and curated tables as files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.times import time_literal
from millrace.sinks.versions import KEEP_HOURS, Versions, read_table


def stamp(df: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Add ``uploaded_at``: one time for the whole load."""
    at = F.current_timestamp() if as_of is None else time_literal(as_of).cast("timestamp")
    return df.withColumn("uploaded_at", at)


def replace_raw(df: DataFrame, path: str, as_of: datetime | None = None, table: str | None = None, keep_hours: float = KEEP_HOURS) -> DataFrame:
    """Replace the raw table at ``path`` by a stamped ``df`` and return what was stored.

    Readers have the old rows until all new ones are there. ``table`` also registers it in the catalog: ``raw.<table>`` is a view of the
    newest version, which is replaced in one step too.
    """
    spark = df.sparkSession
    stored = Versions(spark, path)
    folder = stored.replace(stamp(df, as_of), keep_hours=keep_hours)
    if table is None:
        return stored.read()
    spark.sql("CREATE DATABASE IF NOT EXISTS raw")
    return version_view(spark, folder, f"raw.{table}")


def version_view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Point the catalog's view ``name`` at one stored version."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{folder}`")
    return spark.table(name)


def publish_curated(spark: SparkSession, source: str, dest: str, fmt: str = "parquet", keep_hours: float = KEEP_HOURS) -> DataFrame:
    """Copy a finished dataset to the curated area; readers of ``read_table`` have what was there until the copy is whole."""
    if source.rstrip("/") == dest.rstrip("/"):
        raise ValueError("source and destination are the same")
    curated = Versions(spark, dest)
    curated.replace(read_table(spark, source, fmt), fmt=fmt, keep_hours=keep_hours)
    return curated.read()
