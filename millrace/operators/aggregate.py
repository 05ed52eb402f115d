"""Group a clean table and compute metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, NumericType, StructType

from millrace.functions.names import safe_name
from millrace.spec import MetricSpec, SpecError


def aggregate(df: DataFrame, group_by: Sequence[str], metrics: Sequence[MetricSpec]) -> DataFrame:
    """One row per group (NULL is a group), or exactly one row without ``group_by``.

    All five functions combine partially before the shuffle, so a hot group costs one row per task.
    """
    keys, columns = _parts(df.schema, group_by, metrics)
    return df.groupBy(*keys).agg(*[F.expr(e).alias(name) for e, name in columns])


def aggregate_sql(schema: StructType, table: str, group_by: Sequence[str], metrics: Sequence[MetricSpec]) -> str:
    """The same as one SELECT over ``table``, which has the columns of ``schema``."""
    keys, columns = _parts(schema, group_by, metrics)
    names = [f"`{k}`" for k in keys]
    text = f"select {', '.join([*names, *(f'{e} as `{name}`' for e, name in columns)])} from {table}"
    return f"{text} group by {', '.join(names)}" if keys else text


def _parts(schema: StructType, group_by: Sequence[str], metrics: Sequence[MetricSpec]) -> tuple[list[str], list[tuple[str, str]]]:
    """The keys, and (SQL expression, name) of each metric."""
    if not metrics:
        raise SpecError("an aggregated table needs at least one metric")
    types = {f.name.lower(): f.dataType for f in schema.fields}
    keys = [safe_name(g) for g in group_by]
    for key in keys:
        _known(types, key)
    return keys, [(_metric(m, types), m.output) for m in metrics]


def _metric(metric: MetricSpec, types: dict[str, DataType]) -> str:
    if metric.counts_rows:
        return "count(1)"
    name = safe_name(metric.column)
    data_type = _known(types, name)
    if metric.function in ("SUM", "AVG") and not isinstance(data_type, NumericType):
        raise SpecError(f"{metric.function} needs a number, {name!r} is {data_type.simpleString()}")
    return f"{metric.function.lower()}(`{name}`)"


def _known(types: dict[str, DataType], name: str) -> DataType:
    if name not in types:
        raise SpecError(f"unknown column {name!r}")
    return types[name]
