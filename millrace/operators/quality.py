"""Checks on finished tables; each gives ``(check, observed, expected, passed)`` rows or the like."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.times import time_literal
from millrace.operators.latest import latest_by


class CheckFailed(RuntimeError):
    """At least one quality check did not pass."""


@dataclass(frozen=True)
class ExpectedColumn:
    type: str
    nullable: bool = True


def row_count(df: DataFrame, min_rows: int = 1, name: str = "row_count") -> DataFrame:
    """The table holds at least ``min_rows`` rows."""
    return df.agg(F.count(F.lit(1)).alias("observed")).select(
        F.lit(name).alias("check"), "observed", F.lit(min_rows).cast("bigint").alias("expected"),
        (F.col("observed") >= min_rows).alias("passed"),
    )


def schema(df: DataFrame, expected: Mapping[str, ExpectedColumn]) -> DataFrame:
    """Every expected column is there with its type and, where required, without NULL; none is extra.

    The NULLs of all required columns are counted in one pass.
    """
    actual = dict(df.dtypes)
    required = [c for c, e in expected.items() if not e.nullable and c in actual]
    nulls = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in required])

    def line(name: str) -> Column:
        want, have = expected.get(name), actual.get(name)
        missing = F.col(f"`{name}`") if name in required else F.lit(0).cast("bigint")
        return F.struct(
            F.lit(name).alias("column"),
            F.lit(want.type if want else None).cast("string").alias("expected_type"),
            F.lit(have).cast("string").alias("actual_type"),
            missing.alias("null_rows"),
            (F.lit(want is not None and want.type == have) & (missing == 0)).alias("passed"),
        )

    names = [*expected, *(c for c in actual if c not in expected)]
    return nulls.select(F.explode(F.array(*[line(n) for n in names])).alias("r")).select("r.*")


def freshness(df: DataFrame, column: str, max_age: timedelta, as_of: datetime, name: str = "freshness") -> DataFrame:
    """The newest value of ``column`` is at most ``max_age`` before ``as_of``; an empty table fails."""
    newest = F.col("newest")
    age = F.unix_seconds(time_literal(as_of).cast("timestamp")) - F.unix_seconds(newest.cast("timestamp"))
    limit = int(max_age.total_seconds())
    return df.agg(F.max(column).alias("newest")).select(
        F.lit(name).alias("check"), age.alias("observed"), F.lit(limit).cast("bigint").alias("expected"),
        F.coalesce(age <= limit, F.lit(False)).alias("passed"),
    )


def dedupe(df: DataFrame, keys: Sequence[str], newest: Sequence[str | Column]) -> DataFrame:
    """One row per key, the newest."""
    return latest_by(df, keys, newest)


def require(checks: DataFrame) -> DataFrame:
    """Raise if a check failed, naming each; a table of checks has a row per check, not per row of data."""
    failed = checks.filter(~F.col("passed")).collect()
    if failed:
        raise CheckFailed("; ".join(str(r.asDict()) for r in failed))
    return checks
