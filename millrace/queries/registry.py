"""The registered queries, each with SQL that gives the same rows on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DecimalType, TimestampType

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query. ``sql`` names its columns and types as ``comparable`` leaves them."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(lambda spark, sf_dir: comparable(run(spark, sf_dir)), sql)
        return run

    return register


def comparable(df: DataFrame) -> DataFrame:
    """The types two engines print alike: decimals as double, dates and zoned times as text."""
    return df.select(*[_plain(f) for f in df.schema.fields])


def _plain(field):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, DecimalType):
        return column.cast("double").alias(field.name)
    if isinstance(field.dataType, (DateType, TimestampType)):
        return column.cast("string").alias(field.name)
    return column
