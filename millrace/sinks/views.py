"""The layers clean and analytics, as session views, as views of the catalog or as stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.names import safe_name
from millrace.sinks.tables import version_view
from millrace.sinks.versions import KEEP_HOURS, Versions

LAYERS = ("raw", "clean", "analytics")


def view_name(layer: str, table: str) -> str:
    """Session views live in no database, so the layer is a prefix: ``clean_orders``."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; use one of {LAYERS}")
    return f"{layer}_{safe_name(table)}"


def create_view(df: DataFrame, layer: str, table: str) -> str:
    """Create or replace a lazy view; it is computed each time it is read."""
    name = view_name(layer, table)
    df.createOrReplaceTempView(name)
    return name


def catalog_view(spark: SparkSession, select: str, layer: str, table: str) -> str:
    """Create or replace the view ``<layer>.<table>`` in the catalog; it outlives the session as far as the catalog does."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; use one of {LAYERS}")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    name = f"{layer}.{safe_name(table)}"
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {select}")
    return name


def store_table(df: DataFrame, layer: str, table: str, path: str, partition_by: Sequence[str] = (), keep_hours: float = KEEP_HOURS) -> str:
    """Create or replace ``<layer>.<table>`` in the catalog, computed once and stored below ``path``.

    Readers have the old rows until all new ones are there. Filters on the columns of ``partition_by`` skip whole folders.
    """
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; use one of {LAYERS}")
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    name = f"{layer}.{safe_name(table)}"
    version_view(spark, Versions(spark, path).replace(df, partition_by=partition_by, keep_hours=keep_hours), name)
    return name
