"""Newest row per key, without moving every row of a key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_by(df: DataFrame, keys: Sequence[str], newest: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one with the greatest ``newest`` values, compared in order.

    ``max_by`` combines before the shuffle, so a key that holds most of the table still sends one
    row per task. Give enough columns in ``newest`` to break every tie.
    """
    order = F.struct(*[_ordered(c).alias(f"k{i}") for i, c in enumerate(newest)])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    grouped = df.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)])
    return grouped.agg(F.max_by(row, order).alias("row")).select("row.*")


def newest_first(df: DataFrame, by: str, n: int, tie_breaker: Sequence[str | Column] = ()) -> DataFrame:
    """The ``n`` newest rows, rows without a time last; plans as a top-k, not a full sort."""
    return df.orderBy(F.col(by).desc_nulls_last(), *[_ordered(c) for c in tie_breaker]).limit(n)


def _ordered(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column
